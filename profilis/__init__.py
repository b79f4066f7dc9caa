"""profilis: behavioural-profile analytics expressed as PySpark DataFrame plans."""
