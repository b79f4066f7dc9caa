"""Secret scans: fixed patterns plus a character convolutional network in numpy.

Every candidate (a base match or a long token) is judged with its surrounding
characters; a long one through overlapping windows, of which the highest score counts.
The network is trained here on labelled findings: by default generated ones (random keys
of common shapes in assignment-like, URL-like or plain surroundings and inside long chains
against identifiers, paths, numbers, words, mail addresses and placeholders), or findings
handed in. Its logits are calibrated on findings kept apart. Each kind of candidate (long
ones, ones of letters only, others) has a threshold of its own: the highest that keeps
RECALL of the kind's secrets among those, and of all of them where a kind has too few.

Base matches always stay. Defined results: null and empty texts have no findings;
offsets are code points, ends exclusive; repeated rows are scanned alike, once each; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilis.llm.common import small_batches
from profilis.llm.quality import fit_logistic

# The patterns of the base kinds, in order, with the least lengths.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # equals runs of [0-9a-f]+ of 24 characters or more
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "network")
#: Words one of which every assignment holds, as ASCII lower case.
HINTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: What else the network judges: all tokens of 16 characters or more.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
TOKEN = frozenset(string.ascii_letters + string.digits + "+/_.=-")

LEFT, BODY, RIGHT = 20, 48, 8
WIDTH = LEFT + BODY + RIGHT
RECALL = 0.98
CLASSES = string.ascii_letters + string.digits + " \"'=:/._-+,;()[]{}<>@#$%&*!?\\|\n"
FILTERS, SPAN = 32, 5


# -- windows ------------------------------------------------------------------
def window(text: str, start: int, end: int) -> np.ndarray:
    """Class of each character around and inside a stretch, of which at most BODY characters are seen."""
    end = min(end, start + BODY)
    body = text[start:end]
    left, right = text[max(0, start - LEFT) : start], text[end : end + RIGHT]
    line = left.rjust(LEFT, "\0") + body.ljust(BODY, "\0") + right.ljust(RIGHT, "\0")
    return np.array([_CLASS.get(c, 1) for c in line], dtype=np.int64)


def whole(text: str, start: int, end: int) -> tuple[str, int, int]:
    """A finding as the scanner sees it: the run of token characters that holds it."""
    while start > 0 and text[start - 1] in TOKEN:
        start -= 1
    while end < len(text) and text[end] in TOKEN:
        end += 1
    return text, start, end


def stretches(start: int, end: int) -> list[tuple[int, int]]:
    """Stretches of at most BODY characters, half a BODY apart, that cover a candidate."""
    if end - start <= BODY:
        return [(start, end)]
    return [(a, a + BODY) for a in [*range(start, end - BODY, BODY // 2), end - BODY]]


_CLASS = {"\0": 0} | {c: i + 2 for i, c in enumerate(CLASSES)}
N_CLASSES = len(CLASSES) + 2


@dataclass(frozen=True)
class SecretModel:
    """Weights of a fixed size (about 60 KB)."""

    kernel: np.ndarray  # SPAN * classes, filters
    bias: np.ndarray
    dense: np.ndarray
    offset: float
    slope: float
    shift: float
    thresholds: tuple[float, ...] = (0.5,) * 3

    @property
    def threshold(self) -> float:
        """That of ordinary candidates: neither long nor of letters only."""
        return self.thresholds[2]

    def logits(self, windows: np.ndarray) -> np.ndarray:
        pooled, _ = _pool(windows, self.kernel, self.bias)
        return pooled @ self.dense + self.offset

    def calibrated(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logits + self.shift, -30, 30)))

    def scores(self, windows: np.ndarray) -> np.ndarray:
        return self.calibrated(self.logits(windows))


#: Secrets of a kind, among those kept apart, from which on it has a threshold of its own.
ENOUGH = 40


def kind_of(text: str, start: int, end: int) -> int:
    """0 for a candidate of more than BODY characters, 1 for one without digits, else 2."""
    if end - start > BODY:
        return 0
    return 2 if any("0" <= c <= "9" for c in text[start:end]) else 1


def recall_threshold(scores: np.ndarray) -> float:
    """The highest threshold that RECALL of the scores reach; 0.5 without any."""
    return float(np.sort(scores)[int((1 - RECALL) * len(scores))]) if len(scores) else 0.5


def _pool(windows: np.ndarray, kernel: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Convolution over one-hot characters (rows of the kernel are added), then maxima and means."""
    steps = WIDTH - SPAN + 1
    table = kernel.reshape(SPAN, N_CLASSES, FILTERS)
    out = np.repeat(bias[None, None, :], len(windows), 0).repeat(steps, 1)
    for k in range(SPAN):
        out += table[k][windows[:, k : k + steps]]
    active = np.maximum(out, 0)
    return np.concatenate([active.max(1), active.mean(1)], 1), (active, active.argmax(1))


# -- labelled findings ---------------------------------------------------------
def generated_findings(n: int, seed: int) -> tuple[list[tuple[str, int, int]], np.ndarray]:
    """(text, start, end) of candidates, and whether each is a secret; half are."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    chars = lambda alphabet, a, b: "".join(rng.choice(list(alphabet), int(rng.integers(a, b + 1))))
    word = lambda: _word(rng)
    text = lambda k: " ".join(word() for _ in range(k))
    alnum = string.ascii_letters + string.digits
    plain = lambda k: "".join(pick(SYLLABLES[:-3]) for _ in range(k))
    secrets = [
        lambda: chars("0123456789abcdef", 24, 64),
        lambda: chars(alnum, 20, 48),
        lambda: chars(alnum + "+/", 24, 60) + pick(["", "=", "=="]),
        lambda: "AKIA" + chars(string.ascii_uppercase + string.digits, 16, 16),
        lambda: pick(["ghp_", "sk_live_", "xoxb-", "pk_", "key-"]) + chars(alnum, 20, 36),
        lambda: chars(alnum + "-_", 14, 20) + "." + chars(alnum + "-_", 20, 30),
        lambda: chars(alnum + "+/_.-", 16, 32),
        lambda: chars(string.ascii_letters, 18, 40),
    ]
    others = [
        lambda: "_".join(word() for _ in range(4)) + str(rng.integers(100)),
        lambda: "/".join(["", *(word() for _ in range(4))]) + pick([".py", ".txt", ".html", "/v2", ""]) + str(rng.integers(10)),
        lambda: chars(string.digits, 16, 24),
        lambda: chars(string.digits, 4, 4) + "-" + chars(string.digits, 2, 2) + "-" + chars(string.digits, 12, 16),
        lambda: "".join(word() for _ in range(6)) + str(rng.integers(1000)),
        lambda: ".".join(word() for _ in range(5)) + str(rng.integers(10)) + "." + pick(["com", "org", "net"]),
        lambda: word() + str(rng.integers(10)) + "." + word() + word() + "." + pick(["com", "org", "net", "de"]),
        lambda: word() + pick([".", "_", ""]) + word() + "@" + pick(["mail", "www", "ftp", "host", "node"]) + str(rng.integers(20)) + ".example." + pick(["com", "org", "net"]),
        lambda: pick(["x", "0", "1", "a", "-", "_", "="]) * int(rng.integers(16, 40)) + "1a",
        lambda: pick(["your-token-here-123", "changeme-changeme1", "example_key_1234567", "insert_password_0000"]),
        lambda: "+" + chars(string.digits, 2, 2) + "-" + chars(string.digits, 12, 14),
        lambda: "-".join(word() for _ in range(5)) + "-" + str(rng.integers(2030)),
        lambda: "www." + word() + word() + ".org/" + word() + "/" + str(rng.integers(9999)) + "/" + word(),
        lambda: pick([str, str.capitalize, str.upper])(plain(int(rng.integers(6, 10)))) + pick(["", ".", "...", "-" + word()]),
        lambda: "".join(plain(2).capitalize() for _ in range(int(rng.integers(3, 6)))),
        lambda: pick(["_", "-", "/", "."]).join(plain(2) for _ in range(int(rng.integers(4, 7)))),
        lambda: pick(["-", "=", "_", ".", "/", "+", "-=", "./", "=-", "+-", "--+"]) * int(rng.integers(16, 60)),
        lambda: plain(3) + pick([".", "_", "-"]) + plain(3) + str(rng.integers(10)) * int(rng.integers(2)) + "@" + plain(3) + "-" + plain(2) + pick([".com", ".org", ".example.net", ".de"]),
    ]
    found, labels = [], np.zeros(n)
    for i in range(n):
        labels[i] = secret = i % 2
        body = pick(secrets)() if secret else pick(others)()
        before, after = text(6) + " ", " " + text(3)
        if secret and rng.random() < 0.2:  # credentials in URLs
            before += pick(["https", "http", "postgres", "mysql", "redis", "amqp", "ftp"]) + "://" + pick([word() + ":", ":", ""])
            after = "@" + word() + pick([".com", ".org", ":5432", ""]) + "/" + word() + after
        elif secret and rng.random() < 0.6:
            before += pick(["token = \"", "password: ", "secret=", "api_key = '", "Bearer ", "key: ", "export KEY="])
        elif rng.random() < 0.4:
            before += pick(["see ", "file ", "url: ", "id = ", "http://", "ref: ", "(", "| ", word() + "@", word() + "." + word() + "@", "mailto:" + word() + "@"])
        if not secret and rng.random() < 0.05:  # the host after credentials
            before += pick(["https://", "http://"]) + word() + ":" + chars(alnum, 16, 36) + "@"
            body = (plain(2) + pick([".com/", ".org/", ".de/"]) + pick([word(), "x"]) + "/" + plain(3))[:16] + pick([".git", "", ".html"])
        if not secret and "@" in body:  # the scanner's candidates don't reach across it
            head, _, tail = body.partition("@")
            if len(head) >= 16 and rng.random() < 0.5:
                body, after = head, "@" + tail + after
            else:
                body, before = tail, before + head + "@"
        found.append((before + body + after, len(before), len(before) + len(body)))
    return found, labels


#: Parts of words; those before the last three are plain letters.
SYLLABLES = (
    "th en re on tion ver sch ou la er ing ba ko mi inter nation al iz con trol ler get set value of config auth ent ic ate re spons ibil ity data base de fault hand stream "
    "buf fer micro elec tro mag net ver wal tung keit heit lich ung ge aus ein ment eux ais elle que os cion mente per sub trans form at str quer y ex ten sion ful ness ly ward "
    "ship graph ph oto syn the sis psy cho log work flow test case file path name user in dex html js css vw zz 2 v1 x86"
).split()


def _word(rng: np.random.Generator) -> str:
    """A word of known parts or of random syllables."""
    n = int(rng.integers(1, 5))
    if rng.random() < 0.75:
        return "".join(SYLLABLES[i] for i in rng.integers(0, len(SYLLABLES) - 3, n)) + ("ció" if rng.random() < 0.03 else "")
    return "".join("bcdfghjklmnprstvwz"[rng.integers(18)] + "aeiouy"[rng.integers(6)] + ("", "n", "r", "s", "t", "l")[rng.integers(6)] for _ in range(n))


def long_findings(n: int, seed: int) -> tuple[list[tuple[str, int, int]], np.ndarray]:
    """Like ``generated_findings``, of candidates longer than BODY; secrets stand anywhere in them."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    alnum = string.ascii_letters + string.digits
    chars = lambda alphabet, a, b: "".join(rng.choice(list(alphabet), int(rng.integers(a, b + 1))))
    found, labels = [], np.zeros(n)
    for i in range(n):
        labels[i] = secret = i % 2
        join, size = pick("/._-="), int(rng.integers(BODY + 2, 5 * BODY))
        steps: list[str] = []
        while len(join.join(steps)) < size:
            steps.append(pick([_word(rng), _word(rng) + _word(rng), _word(rng).capitalize(), str(rng.integers(10000)), SYLLABLES[-1 - int(rng.integers(8))], _word(rng) + "=" + _word(rng)]))
        if secret:
            key = pick(["", "", "ghp_", "sk_live_", "xoxb-", "key="]) + chars(pick([alnum, alnum, string.ascii_letters, alnum + "+_-"]), 20, 40)
            steps.insert(int(rng.integers(len(steps) + 1)), key)
        body = join.join(steps).replace("ó", "o")
        odd = rng.random()
        if odd < 0.15 and secret:
            body = "eyJ" + ".".join(chars(alnum + "-_", 20, 80) for _ in range(3))
        elif odd < 0.15:
            body = pick(["-", "=", "_", ".", "/", "-=", "=-=", "0", "a", "+--", "0123456789"]) * (size // 2)
        before, after = _word(rng) + pick([" ", ": ", "://", " (", "@"]), pick([" ", ") ", "@", "? "]) + _word(rng)
        found.append((before + body + after, len(before), len(before) + len(body)))
    return found, labels


def train_secrets(findings: tuple[list[tuple[str, int, int]], np.ndarray] | None = None, seed: int = 11, epochs: int = 8) -> SecretModel:
    """Adam on the logistic loss of each finding's highest window; a fifth of the findings is kept for calibration and threshold."""
    if findings is None:
        (short, a), (long, b) = generated_findings(5000, seed), long_findings(2400, seed + 1)
        findings = short + long, np.concatenate([a, b])
    rows, labels = [whole(*f) for f in findings[0]], findings[1]
    rng = np.random.default_rng(seed)
    views = [stretches(a, b) for _, a, b in rows]
    x = np.stack([window(text, a, b) for (text, _, _), parts in zip(rows, views, strict=True) for a, b in parts])
    sizes = np.array([len(v) for v in views])
    first = np.cumsum(sizes) - sizes
    y = np.asarray(labels, dtype=np.float32)
    order = rng.permutation(len(y))
    kept, used = order[: len(y) // 5], order[len(y) // 5 :]

    def windows_of(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of x of these findings, and where each finding begins among them."""
        return np.concatenate([np.arange(first[f], first[f] + sizes[f]) for f in some]), np.cumsum(sizes[some]) - sizes[some]

    weights = [w.astype(np.float32) for w in (rng.normal(0, 0.05, (SPAN * N_CLASSES, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.1, 2 * FILTERS), np.zeros(1))]
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in weights]
    steps, t, one_hot = WIDTH - SPAN + 1, 0, np.eye(N_CLASSES, dtype=np.float32)
    for _ in range(epochs):
        rng.shuffle(used)
        for batch in np.array_split(used, max(1, len(used) // 128)):
            at, begin = windows_of(batch)
            pooled, (active, top) = _pool(x[at], weights[0], weights[1])
            each = pooled @ weights[2]
            best = np.array([a + each[a : a + n].argmax() for a, n in zip(begin, sizes[batch], strict=True)])
            pooled, active, top, seen = pooled[best], active[best], top[best], x[at[best]]
            error = (1 / (1 + np.exp(-np.clip(pooled @ weights[2] + weights[3], -30, 30))) - y[batch]) / np.float32(len(batch))
            back = error[:, None] * weights[2][None]
            grow = np.repeat(back[:, None, FILTERS:] / np.float32(steps), steps, 1)
            i, j = np.meshgrid(np.arange(len(batch)), np.arange(FILTERS), indexing="ij")
            grow[i, top, j] += back[:, :FILTERS]
            grow *= active > 0
            flat = grow.reshape(-1, FILTERS)
            kernel = np.concatenate([one_hot[seen[:, k : k + steps].ravel()].T @ flat for k in range(SPAN)])
            grads = [kernel, grow.sum((0, 1)), pooled.T @ error, np.array([error.sum()])]
            t += 1
            for w, g, (m, v) in zip(weights, grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= 0.01 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    raw = SecretModel(weights[0], weights[1], weights[2], float(weights[3][0]), 1.0, 0.0)
    at, begin = windows_of(kept)
    logits = np.maximum.reduceat(np.concatenate([raw.logits(x[at[i : i + 1024]]) for i in range(0, len(at), 1024)]), begin)
    (slope,), shift = fit_logistic(logits[:, None], y[kept])
    scores = SecretModel(raw.kernel, raw.bias, raw.dense, raw.offset, float(slope), shift).calibrated(logits)
    kinds, secret = np.array([kind_of(*rows[i]) for i in kept]), y[kept] == 1
    of_kind = [scores[secret & (kinds == k)] for k in range(3)]
    thresholds = tuple(recall_threshold(s if len(s) >= ENOUGH else scores[secret]) for s in of_kind)
    return SecretModel(raw.kernel, raw.bias, raw.dense, raw.offset, float(slope), shift, thresholds)


# -- scanning ------------------------------------------------------------------
def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of base matches, by start and kind."""
    found: list[tuple[int, int, int]] = []
    raw = text.encode().lower()
    if any(h in raw for h in HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Long tokens that don't lie inside a base match."""
    out, at = [], 0
    reach = 0  # the furthest end of base matches that start no later than a token
    for m in CANDIDATE.finditer(text):
        while at < len(base) and base[at][0] <= m.start():
            reach = max(reach, base[at][2])
            at += 1
        if reach < m.end():
            out.append((m.start(), m.end()))
    return out


class Scanner:
    def __init__(self, model: SecretModel):
        self.model = model

    def scan(self, texts: list[str | None]) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], list[float]]]:
        """For each text: base spans, all spans, and the network's score of each of these."""
        bases = [base_spans(t or "") for t in texts]
        more = [candidates(t or "", b) for t, b in zip(texts, bases, strict=True)]
        out = []
        for text, base, extra in zip(texts, bases, more, strict=True):
            spans = [*base, *((a, 3, b) for a, b in extra)]
            scores = np.zeros(len(spans))
            parts = [(k, a, b) for k, (start, _, end) in enumerate(spans) for a, b in stretches(start, end)]
            for i in range(0, len(parts), 1024):
                some = parts[i : i + 1024]
                np.maximum.at(scores, [k for k, _, _ in some], self.model.scores(np.stack([window(text, a, b) for _, a, b in some])))
            kept = sorted((s, p) for s, p in zip(spans, scores.tolist(), strict=True) if s[1] < 3 or p >= self.model.thresholds[kind_of(text, s[0], s[2])])
            out.append((base, [s for s, _ in kept], [p for _, p in kept]))
        return out


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def masked(text: str | None, spans: list[tuple[int, int, int]], mask: str) -> str | None:
    """The text with each stretch of overlapping findings replaced by the mask."""
    if not spans:
        return text
    out, at = [], 0
    joined: list[list[int]] = []
    for a, _, b in sorted(spans):
        if joined and a < joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])
    for a, b in joined:
        out += [text[at:a], mask]
        at = b
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, model: SecretModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts and digest of base findings, and all spans; no shuffle."""
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(model)
        for batch in batches:
            found = scanner.scan(batch.column(1).to_pylist())
            counts = [[sum(k == kind for _, k, _ in base) for base, _, _ in found] for kind in range(3)]
            digests = [hashlib.sha256(shown(base).encode()).hexdigest() for base, _, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array([shown(s) for _, s, _ in found], pa.string()), pa.array([max(p, default=0.0) for _, _, p in found], pa.float64())],
                names=[id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "top_score"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {id_type}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, top_score double")


def mask_secrets(docs: DataFrame, model: SecretModel, text_col: str = "text", mask: str = "<secret>") -> DataFrame:
    """The same rows and columns with every finding in the text masked; no shuffle."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(model)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            done = [masked(t, spans, mask) for t, (_, spans, _) in zip(texts, scanner.scan(texts), strict=True)]
            columns = list(batch.columns)
            columns[at] = pa.array(done, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.select(*[F.col(f"`{c}`") for c in docs.columns]).mapInArrow(run, docs.schema)
