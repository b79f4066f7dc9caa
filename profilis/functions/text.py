"""Text expressions: cleaning, sections, budgets, augmentation with hash-based chance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from profilis.functions.numbers import fixed, let

END = "[END]"

# Sections of a profile in order, each with its mark, and what makes a line count twice.
MARKS = {
    "OVERVIEW": "[PROFILE]", "CHURN_PROPENSITY": "[CHURN]", "TARGET_WINDOW_14D": "[RECENT]", "TEMPORAL": "[TIME]", "SEQUENCE": "[SEQ]", "PRICE": "[PRICE]",
    "SOCIAL": "[SOCIAL]", "SKU_PROPENSITY": "[SKU]", "CAT_PROPENSITY": "[CAT]", "PROP_SUBSET_STATS": "[STATS]", "CUSTOM": "[MISC]",
}
SECTIONS = list(MARKS)
REPEATED = ("CHURN_", "PROPENSITY", "**")

# Beginnings of portraits that failed, the mark that ends a portrait, and what stands for missing text.
FAILURES = ("- OOM", "- ERR", "- Portrait generation failed")
FIN = "— FIN —"
NO_PORTRAIT = "- Behavioural signal too sparse to summarise."
NOTHING_GENERATED, NO_BULLETS = "nothing was generated", "no bullet in what was generated"
NO_EVENTS = "No event sequence available for this client."
TRUNCATED = "\n[TRUNCATED FOR MEMORY]"

# What lines of the plain augmentation stay for, and the order in which the
# augmentation by section puts a text together again; other sections are left out.
KEPT_MARKS = ("##", "[CLIENT_", "[END]", FIN)
AUGMENTED = [
    "[PROFILE]", "## OVERVIEW ##", "## CHURN_PROPENSITY ##", "## RECENT ##", "## TARGET_WINDOW_14D ##", "## TEMPORAL ##", "## SEQ ##", "## PRICE ##", "## SOCIAL ##", "## SKU_PROPENSITY ##",
    "## CAT_PROPENSITY ##", "## STATS ##", "## MISC ##", "## CUSTOM ##", "## PORTRAIT ##", "## RAW_SEQUENCE ##", "[END]",
]
MASKED = "EVENT: [MASKED_EVENT]"


def stripped(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def word_count(text: Column) -> Column:
    """Words separated by white space; 0 for blank texts."""
    bare = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, " ")))


def clean_text(text: Column, client: Column | None = None) -> Column:
    """Mentions of a client's id go, whatever their case, and white space is squeezed."""
    for pattern in (r"(?i)\[CLIENT_\d+\]", r"(?i)CLIENT_\d+", r"(?i)client_id:\s*\d+", r"(?i)\"client_id\":\s*\d+,?", r"(?i)'client_id':\s*\d+,?"):
        text = F.regexp_replace(text, pattern, "")
    if client is not None:
        own = client.cast("string")
        for before, after in ((r"(?i)\[CLIENT_", r"\]"), (r"(?i)CLIENT_", r"\b"), (r"\b", r"\b")):
            text = F.regexp_replace(text, F.concat(F.lit(before), own, F.lit(after)), F.lit(""))
    return stripped(F.regexp_replace(text, r"\s+", " "))


def strip_sections(text: Column, cap: int = 6000, keep_raw: bool = False) -> Column:
    """A profile for a prompt: no portrait, raw sequence or end mark; a longer one is cut to ``cap`` characters and says so."""
    for name in ("PORTRAIT",) if keep_raw else ("PORTRAIT", "RAW_SEQUENCE"):
        text = F.regexp_replace(text, rf"(?s)##\s*{name}\s*##.*?(?=##|\z|\[END\])", "")
    text = stripped(F.replace(text, F.lit(END), F.lit("")))
    return F.when(F.length(text) > cap, F.concat(F.substring(text, 1, cap), F.lit(TRUNCATED))).otherwise(text)


def bullets(raw: Column) -> Column:
    """Lines of a generated portrait that begin with ``- ``: no fenced blocks, nothing after the end mark."""
    bare = F.substring_index(F.regexp_replace(raw, r"```[\s\S]*?```", ""), FIN, 1)
    return F.filter(F.transform(F.split(bare, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"), stripped), lambda x: x.startswith("- "))


def clean_portrait(raw: Column, default: str = NO_PORTRAIT) -> Column:
    """Bullets of a generated portrait (the default without any), then the end mark. A missing one
    stays missing, and one that reports a failure stays as it is."""
    clean = let(bullets(raw), lambda lines: F.concat(F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(F.lit(default)), F.lit("\n" + FIN)))
    return F.when(is_failure(raw), raw).otherwise(clean)


def portrait_error(raw: Column) -> Column:
    """Why a portrait is none: nothing was generated, a failure was reported, or no bullet was said; null of a sound one."""
    return F.when(raw.isNull(), NOTHING_GENERATED).when(is_failure(raw), stripped(F.substring_index(raw, FIN, 1))).when(F.size(bullets(raw)) == 0, NO_BULLETS)


def is_failure(text: Column) -> Column:
    """Whether a portrait reports a failure; a missing one does."""
    bare = F.regexp_replace(text, r"^\s+", "")
    failed = F.lit(False)
    for mark in FAILURES:
        failed |= bare.startswith(mark)
    return F.coalesce(failed, F.lit(True))


def insert_before_end(text: Column, block: Column) -> Column:
    """Puts a block before the last end mark, or at the end if there is none."""
    at = F.length(text) - F.length(F.substring_index(text, END, -1)) - len(END)
    has = F.contains(text, F.lit(END))
    return F.when(has, F.concat(F.substr(text, F.lit(1), at.cast("int")), block, F.lit("\n"), F.substr(text, (at + 1).cast("int")))).otherwise(F.concat(text, F.lit("\n"), block, F.lit("\n" + END)))


def last_chunks(text: Column, n: int, mark: str = "</s>") -> Column:
    """The last n non-empty chunks between marks, trimmed and joined again."""
    chunks = F.filter(F.transform(F.split(text, mark), lambda x: F.trim(x)), lambda x: x != "")
    kept = F.slice(chunks, F.greatest(F.lit(1), F.size(chunks) - n + 1), F.lit(n))
    return F.array_join(kept, mark)


def truncated_sequence(text: Column, n: int, mark: str = "</s>") -> Column:
    """The last n events of a raw sequence, with a notice if any were cut; a default text without events."""
    chunks = F.filter(F.transform(F.split(text, mark), stripped), lambda x: x != "")

    def shown(events: Column) -> Column:
        tail = F.array_join(F.slice(events, F.greatest(F.lit(1), F.size(events) - n + 1), F.lit(n)), mark)
        return F.when(F.size(events) > n, F.concat(F.lit(f"... (truncated to last {n} events)\n"), tail)).when(F.size(events) > 0, tail)

    return F.coalesce(let(chunks, shown), F.lit(NO_EVENTS))


def instruct(task: str, query: Column) -> Column:
    return F.concat(F.lit(f"Instruct: {task}\nQuery:"), query)


def digits(text: Column) -> Column:
    """The number that a text's digits make; 0 without any."""
    return F.coalesce(F.regexp_replace(text, "[^0-9]", "").try_cast("bigint"), F.lit(0).cast("bigint"))


def word_hash(text: Column, size: int = 13) -> Column:
    """The first ``size`` hex digits of the MD5 as a number; the same in any engine."""
    return F.conv(F.substring(F.md5(text), 1, size), 16, 10).cast("bigint")


def chance(*of: Column) -> Column:
    """A number in [0, 1) that depends on its arguments only."""
    return word_hash(F.concat_ws(":", *[c.cast("string") for c in of])) / F.lit(float(16**13))


# -- lines of sections ------------------------------------------------------------------
def deduplicated(lines: DataFrame, key: str = "client_id") -> DataFrame:
    """The first of lines that are equal but for case and outer space, over all sections."""
    w = W.partitionBy(key, F.lower(F.trim("line"))).orderBy("section", "pos")
    return lines.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def within_budget(lines: DataFrame, limit: int, key: str = "client_id") -> DataFrame:
    """Lines up to the first that would exceed a budget of words."""
    words = F.sum(word_count(F.col("line"))).over(W.partitionBy(key).orderBy("section", "pos").rowsBetween(W.unboundedPreceding, 0))
    return lines.withColumn("words_so_far", words).where(F.col("words_so_far") <= limit)


def assembled(lines: Column, key: Column, limit: int = 4096, per_section: int = 10, seed: int | None = None, markers: bool = True, sections: list[str] | None = None) -> Column:
    """One text from lines (structs with section and line, in order).

    Lines equal to an earlier one but for case and outer space go, sections in order of their
    first line; each section shows its first ``per_section`` lines under its mark and name,
    marked lines twice, and after the first two in an order that a hash of key, section and
    place gives (without a seed as they come). Lines are taken up to the first that
    exceeds ``limit`` words; then comes the end mark.
    """
    names = sections or SECTIONS
    repeated = lambda x: F.array_contains(F.transform(F.array(*[F.lit(m) for m in REPEATED]), lambda m: F.contains(x, m)), True)

    def distinct(all_lines: Column) -> Column:
        order = let(F.transform(all_lines, lambda x: x["section"]), lambda s: F.transform(all_lines, lambda x, i: F.struct(F.array_position(s, x["section"]).alias("first"), i.alias("i"), x["section"].alias("section"), x["line"].alias("line"))))
        put = lambda rows: let(F.transform(rows, lambda x: F.lower(F.trim(x["line"]))), lambda same: F.filter(rows, lambda x, i: F.array_position(same, F.lower(F.trim(x["line"]))) == i + 1))
        return let(F.array_sort(order), put)

    def section(rows: Column, name: str) -> Column:
        top = F.slice(F.filter(rows, lambda x: x["section"] == name), 1, per_section)
        twice = F.flatten(F.transform(top, lambda x: F.when(repeated(x["line"]), F.array(x["line"], x["line"])).otherwise(F.array(x["line"]))))
        if seed is not None:
            turn = lambda i: F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)), F.lit(name), i.cast("string")))
            mixed = lambda r: F.concat(F.slice(r, 1, 2), F.transform(F.array_sort(F.transform(F.slice(r, 3, 2 * per_section), lambda x, i: F.struct(turn(i).alias("t"), x.alias("x")))), lambda x: x["x"]))
            twice = let(twice, lambda r: F.when(F.size(r) > 3, mixed(r)).otherwise(r))
        head = [F.lit(MARKS[name])] if markers and name in MARKS else []
        return let(twice, lambda r: F.when(F.size(r) > 0, F.concat(F.array(*head, F.lit(f"## {name} ##")), r)).otherwise(F.expr("cast(array() as array<string>)")))

    def cut(rows: Column) -> Column:
        start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("kept"))
        step = lambda a, x: F.struct((a["words"] + word_count(x)).alias("words"), F.when(a["words"] + word_count(x) <= limit, a["kept"] + 1).otherwise(a["kept"]).alias("kept"))
        return F.slice(rows, F.lit(1), F.aggregate(rows, start, step)["kept"])

    body = let(let(lines, distinct), lambda rows: F.flatten(F.array(*[section(rows, n) for n in names])))
    return F.array_join(F.concat(let(body, cut), F.array(F.lit(END))), "\n")


def rich_text(lines: DataFrame, limit: int = 4096, per_section: int = 10, seed: int | None = None, key: str = "client_id", markers: bool = False) -> DataFrame:
    """One text per key from long lines (section, pos, line); sections that have no place are left out."""
    place = F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), F.col("section"))
    rows = lines.where(F.col("section").isin(SECTIONS)).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(place.alias("s"), F.col("pos").alias("p"), F.col("section"), F.col("line")))).alias("__l"))
    return rows.select(key, assembled(F.col("__l"), F.col(key), limit, per_section, seed, markers).alias("rich_text"))


# -- augmentation -------------------------------------------------------------------------
def drop_lines(text: Column, key: Column, p: float = 0.35, seed: int = 42) -> Column:
    """Drops lines by chance; blank ones go, those that hold a kept mark stay, and at least the first two."""
    lines = F.filter(F.split(text, "\n"), lambda x: stripped(x) != "")

    def some(rows: Column) -> Column:
        stays = lambda x: F.contains(x, F.lit(KEPT_MARKS[0])) | F.contains(x, F.lit(KEPT_MARKS[1])) | F.contains(x, F.lit(KEPT_MARKS[2])) | F.contains(x, F.lit(KEPT_MARKS[3]))
        kept = F.filter(rows, lambda x, i: stays(x) | (chance(key, i, F.lit(seed)) > p))
        return let(kept, lambda k: F.when(F.size(k) < 2, F.slice(rows, 1, 2)).otherwise(k))

    return F.array_join(let(lines, some), "\n")


#: Numbers, with the name before them if they belong to one.
NUMBER = r"(?:[A-Z_]+_)?(\d+\.?\d*)"


def noisy_numbers(text: Column, scale: float, *of: Column) -> Column:
    """Every number moved by up to ``scale`` of itself; those behind a name like SKU_ stay."""
    parts = F.struct(F.split(text, NUMBER, -1).alias("between"), F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)).alias("whole"), F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1)).alias("number"))

    def moved(p: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            number = F.get(p["number"], i).cast("double")
            named = F.regexp_like(x, F.lit(r"^[A-Z_]*[A-Z][A-Z_]*_|^[A-Z]+_"))
            return F.when(named & F.regexp_like(F.substring_index(x, "_", 1), F.lit("[A-Z]")), x).otherwise(fixed(number + number * scale * (2 * chance(*of, i) - 1), 2))

        return F.concat(p["between"][0], F.array_join(F.transform(p["whole"], lambda x, i: F.concat(one(x, i), F.get(p["between"], i + 1))), ""))

    return let(parts, moved)


def augment_sections(text: Column, key: Column, seed: int = 42, drop: float = 0.4, mask: float = 0.3, mask_share: float = 0.15, noise: float = 0.2, scale: float = 0.05, reorder: float = 0.1, block: int = 3) -> Column:
    """Augmentation section by section: dropout, lines reordered in blocks, events masked, numbers moved.

    The profile mark, overview, portrait, raw sequence and end are never dropped; the raw
    sequence isn't reordered, and only its events are masked. A section that appears twice
    counts as its last; those without a place are left out. All chance is a hash of key, seed,
    section and place, so results repeat.
    """
    header = r"## [A-Z0-9_]+ ##"
    profile = F.regexp_extract(text, rf"(?s)^(\[PROFILE\].*?)(?={header})", 1)
    rest = F.when(profile != "", F.substr(text, F.length(profile) + 1)).otherwise(text)
    rows = F.split(rest, rf"(?m)(?=^{header}\n)", -1)

    def section(parts: Column, name: str) -> Column:
        luck = lambda what, *more: chance(key, F.lit(seed), F.lit(name), F.lit(what), *more)
        if name == "[PROFILE]":
            content = stripped(profile)
        elif name == END:
            content = F.when(F.contains(text, F.lit(END)), F.lit(END)).otherwise(F.lit(""))
        else:
            mine = F.filter(parts, lambda x: x.startswith(name + "\n"))
            content = stripped(F.coalesce(F.substr(F.try_element_at(mine, F.lit(-1)), F.lit(len(name) + 2)), F.lit("")))

        def changed(c: Column) -> Column:
            out = c
            if name not in ("[PROFILE]", END, "## RAW_SEQUENCE ##"):
                lines = F.split(c, "\n")
                mixed = lambda x: F.concat(F.flatten(F.transform(F.array_sort(F.transform(F.sequence(F.lit(0), F.floor(F.size(x) / block).cast("int") - 1), lambda b: F.struct(luck("order", b).alias("t"), F.slice(x, b * block + 1, F.lit(block)).alias("x")))), lambda b: b["x"])), F.slice(x, F.floor(F.size(x) / block).cast("int") * block + 1, F.lit(block)))
                out = let(lines, lambda x: F.when((F.size(x) > block) & (luck("reorder") < reorder), F.array_join(mixed(x), "\n")).otherwise(c))
            if name == "## RAW_SEQUENCE ##":
                events = F.filter(F.transform(F.split(c, "</s>"), stripped), lambda x: x != "")
                masked = F.array_join(F.transform(events, lambda x, i: F.when(luck("event", i) < mask_share, MASKED).otherwise(x)), "</s>")
                out = F.when(luck("mask") < mask, masked).otherwise(c)
            return let(out, lambda x: F.when(luck("noise") < noise, noisy_numbers(x, scale, key, F.lit(seed), F.lit(name), F.lit("number"))).otherwise(x))

        gone = F.lit(False) if name in ("[PROFILE]", "## OVERVIEW ##", "## RAW_SEQUENCE ##", "## PORTRAIT ##", END) else luck("drop") < drop
        lead = "" if name == "[PROFILE]" else "\n" if name == END else f"\n{name}\n"
        always = name in ("[PROFILE]", END)
        return let(content, lambda c: F.when((F.lit(always) | (c != "")) & ~gone, F.concat(F.lit(lead), changed(c))).otherwise(F.lit("")))

    whole = let(rows, lambda parts: F.concat(*[section(parts, name) for name in AUGMENTED]))
    return F.regexp_replace(stripped(whole), r"\n{3,}", "\n\n")
