"""Secret scans: fixed patterns, and a linear-chain conditional random field over tokens.

Base patterns, leftmost and non-overlapping for each kind, on code points; matches that are too short are dropped:
``assign``, ``access`` and ``hex`` (see ``PATTERNS``). They always stay.

The field tags each token (a run of word characters and ``+/.-``, or one other mark) as begin, inside or outside of a secret. Its
features are the token's shape, length, mix of classes, number of class changes and distinct characters, whether it has the form of
an identifier (UUID) or of a web token, and whether it is one of a few telling words; the same in brief of the two tokens before and
the one after; and the file's share of digits and of symbols. It is trained here by maximum likelihood (forward-backward, Adam) on
drawn examples of credentials of many kinds (keys, web tokens, passwords named in a sentence, passwords in addresses) and of numbers,
addresses, links, identifiers and versions that are none, and on windows of at most ``SAMPLE`` documents, in order of their ids' hashes,
whose base matches are the labels; at most ``PER_TEXT`` windows with a match are taken from a document.
Decoding is by Viterbi. Where a token's score for outside beats the others by more than any change of transitions can win back,
every best path passes outside there; only the stretches between such tokens are decoded, with the same result.

A ``crf`` span is a tagged run of tokens that touches no base span.

Edge cases: null texts are empty and have no spans; repeated rows have equal results; an empty table trains on the drawn examples
alone. Other columns are ignored, or kept by :func:`redact`. Documents are read by independent tasks, never shuffled.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


# The base patterns.
PATTERNS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]{24,}"),  # whole runs of [0-9a-f]+ of 24 or more
}
KINDS = ("assign", "access", "hex", "crf")
SAMPLE, PER_TEXT, SEED = 400, 20, 7
#: Words that often stand beside credentials.
TELLING = ("password", "passwd", "pwd", "secret", "token", "api", "apikey", "api_key", "key", "access", "auth", "bearer", "credential", "credentials", "private", "login", "aws", "client_secret", "access_key", "authorization")
#: Words whose neighbours they tell about.
CONTEXT = ("is", "was", "commit", "sha", "sha256", "md5", "checksum", "digest", "uuid", "id", "request", "session", "version", "build", "order", "invoice", "ticket", "phone", "basic", "user", "username", "pass", "passphrase", "connect", "with")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
WEB_TOKEN = re.compile(r"eyJ[\w\-]{8,}\.[\w\-]{4,}(?:\.[\w\-]*)?")
PREFIX = re.compile(r"(?:gh[pousr]_|glpat-|xox[abps]-|sk-|sk_|pk_|rk_|AIza|ya29\.|npm_|hf_)")
TOKEN = re.compile(r"[\w+/.\-]+|[^\s\w]")
OUT, BEGIN, IN = 0, 1, 2


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, by start and then kind."""
    out: list[tuple[int, int, int]] = []
    low = text.lower() if "=" in text or ":" in text else ""
    if any(w in low for w in ("passw", "secret", "token", "api")):
        out += [(m.start(), 0, m.end()) for m in PATTERNS["assign"].finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in PATTERNS["access"].finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in PATTERNS["hex"].finditer(text)]
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


# ---------------------------------------------------------------- features

_NAMES: dict[str, int] = {}


def _feature(name: str) -> int:
    return _NAMES.setdefault(name, len(_NAMES))


def _shape(token: str) -> str:
    return re.sub(r"(.)\1+", r"\1", re.sub(r"[^\W\d_]", "a", re.sub(r"[a-zß-öø-ÿ]", "a", re.sub(r"[A-ZÀ-ÖØ-Þ]", "A", re.sub(r"\d", "0", token)))))[:6]


def token_features(token: str) -> tuple[list[str], list[str]]:
    """Names of a token's own features, and of those that its neighbours see."""
    n = len(token)
    if n == 1 and not token.isalnum():
        return [f"mark={token}"], [f"mark={token}"]
    low = token.lower()
    if token.isalpha():
        case = "a" if token.islower() else "A" if token.isupper() else "Aa" if token[1:].islower() else "aA"
        own = [f"word={case}", f"length={min(n, 24) // 3}"]
        brief = [f"word={case}"]
        if case == "aA" and n >= 12:
            own.append(f"changes={min(sum(x.isupper() != y.isupper() for x, y in zip(token, token[1:])), 12) // 2}")
    else:
        kinds = "".join(sorted({"0" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c for c in token}))
        changes = sum(a.isdigit() != b.isdigit() or a.isupper() != b.isupper() for a, b in zip(token, token[1:]))
        hexes = all(c in "0123456789abcdef" for c in token) or all(c in "0123456789ABCDEF" for c in token)
        own = [f"shape={_shape(token)}", f"kinds={kinds[:5]}", f"length={min(n, 48) // 4}", f"changes={min(changes, 12) // 2}", f"distinct={min(len(set(token)), 24) // 4}"]
        own += [f"hex={min(n, 40) // 8}"] if hexes and not token.isdigit() else []
        own += ["digits"] if token.isdigit() else []
        own += ["uuid"] if n == 36 and UUID.fullmatch(token) else ["web-token"] if token.startswith("eyJ") and WEB_TOKEN.fullmatch(token) else ["prefix"] if n >= 16 and PREFIX.match(token) else []
        own += ["word-and-digits"] if 6 <= n < 16 and kinds[:1] == "0" and any(c.isalpha() for c in token) and "." not in token and "/" not in token else []
        own += ["long-mixed"] if n >= 16 and "0" in kinds and ("a" in kinds or "A" in kinds) and changes >= 4 and "." not in token else []
        brief = ["digits"] if token.isdigit() else ["slashes"] if token.startswith("//") else [f"mixed={min(n, 24) // 8}"]
    if low in TELLING or any(low.endswith(s) for s in ("_key", "_token", "_secret", "password")):
        own.append("telling")
        brief.append("telling")
    if low in CONTEXT:
        brief.append(f"word={low}")
    return own, brief


def file_features(text: str) -> list[str]:
    n = max(1, len(text))
    # Shares in steps, from counts that need no pass in Python.
    digits = sum(text.count(d) for d in "0123456789") / n
    marks = sum(text.count(m) for m in "={}<>$%&*#|") / n
    return [f"file-digits={min(4, int(digits * 40))}", f"file-marks={min(4, int(marks * 40))}"]


class Field:
    """The conditional random field: weights of features by tag, and of transitions."""

    def __init__(self, weights: dict[str, np.ndarray], steps: np.ndarray):
        self.weights, self.steps = weights, steps
        self.gap = 2 * float(steps.max() - steps.min())
        self._reset()

    def __reduce__(self):
        return Field, (self.weights, self.steps)

    def _reset(self) -> None:
        self.rows: dict[str, int] = {"": 0}
        self.plain: dict[tuple, int] = {}
        self.table = np.zeros((1 << 12, 4, 3), np.float32)
        self.count = 1

    def _of(self, names: list[str], prefix: str) -> np.ndarray:
        zero = np.zeros(3)
        return sum((self.weights.get(prefix + x, zero) for x in names), zero)

    def _row(self, token: str) -> int:
        """Scores of a token for itself, for the token after it, the one after that, and the one before it."""
        key = None
        if token.isalpha() and token.lower() not in TELLING and token.lower() not in CONTEXT and (token.islower() or token.isupper() or token[1:].islower()) and not token.lower().endswith("password"):
            key = (token.islower(), token.isupper(), min(len(token), 24))
            at = self.plain.get(key)
            if at is not None:
                self.rows[token] = at
                return at
        own, brief = token_features(token)
        at = self.count
        if at >= len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[at] = [self._of(own, "0:"), self._of(brief, "-1:"), self._of(brief, "-2:"), self._of(brief, "+1:")]
        self.count = at + 1
        self.rows[token] = at
        if key is not None:
            self.plain[key] = at
        return at

    def scores(self, tokens: list[str], text: str) -> np.ndarray:
        if len(self.rows) > 120_000:
            self._reset()
        rows = self.rows
        ids = np.array([rows[t] if t in rows else self._row(t) for t in tokens], np.int64)
        table = self.table
        out = table[ids, 0].astype(np.float64)
        out[1:] += table[ids[:-1], 1]
        out[2:] += table[ids[:-2], 2]
        out[:-1] += table[ids[1:], 3]
        return out + self._of(file_features(text), "f:")

    def tag(self, tokens: list[str], text: str) -> list[tuple[int, int]]:
        """First and end token of each tagged run."""
        e = self.scores(tokens, text)
        live = e[:, OUT] - np.maximum(e[:, BEGIN], e[:, IN]) < self.gap
        if not live.any():
            return []
        edge = np.flatnonzero(np.diff(np.concatenate([[False], live, [False]]).astype(np.int8)))
        out: list[tuple[int, int]] = []
        for a, b in edge.reshape(-1, 2).tolist():
            tags = viterbi(e[a:b], self.steps, a > 0, b < len(e))
            start = None
            for k, y in enumerate([*tags, OUT]):
                if start is not None and y != IN:
                    out.append((a + start, a + k))
                    start = None
                if y == BEGIN or (y == IN and start is None):
                    start = k
        return out


def viterbi(e: np.ndarray, steps: np.ndarray, after_out: bool, before_out: bool) -> list[int]:
    """The best tags of a stretch; its neighbours on either side, if any, are outside."""
    s = steps.tolist()
    score = [x + (s[OUT][y] if after_out else 0.0) for y, x in enumerate(e[0].tolist())]
    back = []
    for row in e[1:].tolist():
        came = [max((score[p] + s[p][y], -p) for p in range(3)) for y in range(3)]
        back.append([-c[1] for c in came])
        score = [c[0] + x for c, x in zip(came, row, strict=True)]
    if before_out:
        score = [x + s[y][OUT] for y, x in enumerate(score)]
    y = max(range(3), key=lambda k: (score[k], -k))
    tags = [y]
    for row in reversed(back):
        y = row[y]
        tags.append(y)
    return tags[::-1]


# ---------------------------------------------------------------- training


def drawn_examples(seed: int = SEED, n: int = 900) -> list[tuple[str, list[tuple[int, int]]]]:
    """Lines with credentials (and where these are), and lines with numbers, addresses and links that are none."""
    rng = np.random.default_rng(seed)
    pick = lambda s, k: "".join(rng.choice(list(s), k))
    one = lambda *x: str(x[int(rng.integers(0, len(x)))])
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    mixed, hexes = lower + lower.upper() + digits, "0123456789abcdef"
    word = lambda: pick(lower, int(rng.integers(2, 10)))
    prose = lambda: " ".join(word().title() if rng.random() < 0.15 else word() for _ in range(int(rng.integers(3, 9))))
    uuid = lambda: "-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12))
    human = lambda: one(word().title() + pick(digits, int(rng.integers(2, 5))), word() + pick(digits, 3) + word(), pick(mixed, int(rng.integers(7, 13))) + pick(digits, 2), word() + "_" + pick(digits, 4))
    web = lambda: "eyJ" + pick(mixed, int(rng.integers(12, 40))) + ".eyJ" + pick(mixed, int(rng.integers(16, 60))) + "." + pick(mixed + "_-", int(rng.integers(20, 43)))
    prefixed = lambda: one("ghp_", "gho_", "glpat-", "xoxb-", "sk-", "sk_live_", "npm_", "hf_", "AIza") + pick(mixed, int(rng.integers(16, 40)))
    out = []

    def secret(head: str, value: str, tail: str = "") -> None:
        out.append((head + value + tail, [(len(head), len(head) + len(value))]))

    for _ in range(n):
        kind, size = int(rng.integers(0, 5)), int(rng.integers(16, 44))
        value = (pick(hexes, size), pick(mixed, size), pick(mixed + "+/", size) + "8Z", "AKIA" + pick(lower.upper() + digits, 16), pick(lower, 2) + "_" + pick(mixed, size))[kind]
        name = one(*TELLING, "db_" + word() + "_key", "x-api-key")
        left = one(f'{name} = "', f"{name}: ", f"{name}=", f"{name} is ", "Bearer ", "")
        secret(prose() + " " + left, value, ('" ' if left.endswith('"') else " ") + prose())
        turn = int(rng.integers(0, 4))
        if turn == 0:
            secret(prose() + one(" ", " Authorization: Bearer ", " token ", " jwt="), web(), " " + prose())
        elif turn == 1:
            secret(prose() + " " + one("password", "pwd", "passwd", "passphrase", "the password", "login password", "user " + word() + " pass", "credentials " + word()) + one(" ", " is ", " was ", " for it is "), human(), one(" ", ". ", ", ") + prose())
        elif turn == 2:
            scheme, host = one("postgres", "mysql", "mongodb", "redis", "amqp", "https", "ftp"), one(f"{word()}.{word()}.com", "localhost", f"10.0.{int(rng.integers(0, 99))}.{int(rng.integers(1, 99))}")
            secret(prose() + " " + one("", "url=", "connect ") + f"{scheme}://{one(word(), 'root', 'admin')}:", one(human(), pick(mixed, size)), f"@{host}" + one("", f":{int(rng.integers(1000, 9999))}") + "/" + word() + " " + prose())
        else:
            secret(prose() + one(" ", " use ", " key ", " with "), prefixed(), " " + prose())
        for _ in range(2):
            plain = (
                f"{word()}.{int(rng.integers(1, 99))}@{word()}{int(rng.integers(1, 9))}.example.com",
                f"+{int(rng.integers(1, 99))} ({int(rng.integers(100, 999))}) {pick(digits, 3)}-{pick(digits, 4)}",
                pick(digits, int(rng.integers(4, 20))),
                f"https://www.{word()}.org/{word()}/{word()}-{int(rng.integers(1, 9999))}.html",
                f"{int(rng.integers(1, 255))}.{int(rng.integers(1, 255))}.{int(rng.integers(1, 255))}.{int(rng.integers(1, 255))}",
                f"{pick(digits, 4)}-{pick(digits, 2)}-{pick(digits, 2)}",
                f"the {one(*TELLING)} {word()} {word()}",
                f"{word()}{one('***', '$$$', '###', '&&&', '!!')} {word()} | {word()}",
                f"{word().upper()} {word().upper()}!! {word().upper()}",
                f"{word()}-{word()}-{word()}/{word()}.{word()}",
                pick(lower, int(rng.integers(14, 40))),
                one("id ", "request ", "uuid: ", "session id ", "") + uuid(),
                one("commit ", "sha ", "at ", "build ") + pick(hexes, int(rng.integers(7, 13))),
                f"version {int(rng.integers(0, 9))}.{int(rng.integers(0, 20))}.{int(rng.integers(0, 20))}-{one('rc', 'beta', 'alpha')}{int(rng.integers(1, 9))}",
                one("order ", "invoice ", "ticket ", "model ") + pick(lower.upper(), int(rng.integers(2, 4))) + one("", "-") + pick(digits, int(rng.integers(3, 7))),
                f"{one('password', 'token', 'secret', 'key')} {one('policy', 'manager', 'reset', 'length')} {word()}",
                f"{one('http', 'https', 'ftp')}://{word()}.{word()}.com:{int(rng.integers(80, 9999))}/{word()}",
                f"{word()}{int(rng.integers(1, 99))} and {word()}{int(rng.integers(1, 99))}.{word()}",
                f"{word()}: {word()}@{word()}.com",
                f"{int(rng.integers(1, 12))}:{pick(digits, 2)} {one('am', 'pm')}, {int(rng.integers(1, 99))}kg {int(rng.integers(1, 99))}km/h",
            )[int(rng.integers(0, 20))]
            out.append((prose() + " " + plain + " " + prose(), []))
    return out


def _windows(text: str, spans: list[tuple[int, int]], reach: int = 10, others: int = 3, seed: int = 0) -> Iterator[tuple[list[list[str]], list[int]]]:
    """Feature names and tags of token windows about the labelled spans, and of some without."""
    found = list(TOKEN.finditer(text))
    if not found:
        return
    tags = np.zeros(len(found), int)
    starts = np.array([m.start() for m in found])
    for a, b in spans:
        inside = np.flatnonzero((starts >= a) & (starts < b))
        tags[inside] = IN
        tags[inside[:1]] = BEGIN
    rng = np.random.default_rng(seed)
    centres = [int(x) for x in np.flatnonzero(tags == BEGIN)] + rng.integers(0, len(found), others).tolist()
    file = ["f:" + x for x in file_features(text)]
    for c in centres:
        lo, hi = max(0, c - reach), min(len(found), c + reach)
        seen = {k: token_features(found[k][0]) for k in range(max(0, lo - 2), min(len(found), hi + 1))}
        names = []
        for k in range(lo, hi):
            names.append(["0:" + x for x in seen[k][0]] + ["-1:" + x for x in seen.get(k - 1, ([], []))[1]] + ["-2:" + x for x in seen.get(k - 2, ([], []))[1]] + ["+1:" + x for x in seen.get(k + 1, ([], []))[1]] + file)
        yield names, tags[lo:hi].tolist()


Window = tuple[list[list[str]], list[int]]


def labelled_windows(text: str, seed: int) -> list[Window]:
    """Windows about the first ``PER_TEXT`` base matches of a text, and some others. The value is the secret: of an assignment its second group."""
    spans = [m.span(2) for m in PATTERNS["assign"].finditer(text) if len(m[2]) >= 6] + [(a, b) for a, kind, b in base_spans(text) if kind]
    found = list(_windows(text, spans, seed=seed))
    return found[: min(PER_TEXT, len(spans))] + found[len(spans) :]


def train(texts: list[str], rounds: int = 80, rate: float = 0.08, decay: float = 1e-3) -> Field:
    """:func:`fit_windows` on windows of ``texts``."""
    return fit_windows([w for k, text in enumerate(texts) for w in labelled_windows(text, k)], rounds, rate, decay)


def fit_windows(windows: list[Window], rounds: int = 80, rate: float = 0.08, decay: float = 1e-3) -> Field:
    """Maximum likelihood on drawn examples and on labelled windows."""
    data: list[Window] = []
    for text, spans in drawn_examples():
        data += _windows(text, spans, others=0 if spans else 1)
    data += windows
    names = sorted({x for rows, _ in data for row in rows for x in row})
    place = {x: i for i, x in enumerate(names)}
    wide = max(len(row) for rows, _ in data for row in rows)
    longest = max(len(rows) for rows, _ in data)
    x = np.full((len(data), longest, wide), len(names))
    y = np.zeros((len(data), longest), int)
    mask = np.zeros((len(data), longest), bool)
    for i, (rows, tags) in enumerate(data):
        for t, row in enumerate(rows):
            x[i, t, : len(row)] = [place[f] for f in row]
        y[i, : len(tags)] = tags
        mask[i, : len(tags)] = True
    gold = np.eye(3)[y] * mask[:, :, None]
    both = (mask[:, 1:] & mask[:, :-1])[:, :, None, None]
    pairs = (np.eye(3)[y[:, :-1]][:, :, :, None] * np.eye(3)[y[:, 1:]][:, :, None, :] * both).sum((0, 1))
    w, s = np.zeros((len(names) + 1, 3)), np.zeros((3, 3))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(s), np.zeros_like(s)]
    flat = x.reshape(-1, wide)
    lse = lambda v, axis: (m := v.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - m).sum(axis))
    for step in range(1, rounds + 1):
        e = w[x].sum(2)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for t in range(1, longest):
            new = lse(alpha[:, t - 1][:, :, None] + s, 1) + e[:, t]
            alpha[:, t] = np.where(mask[:, t : t + 1], new, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = lse(s + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(mask[:, t + 1 : t + 2], new, 0)
        z = lse(alpha[:, -1], 1)
        p = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
        q = np.exp(alpha[:, :-1, :, None] + s + (e + beta)[:, 1:, None, :] - z[:, None, None, None]) * both
        diff = (p - gold).reshape(-1, 3)
        gw = np.stack([np.bincount(flat.ravel(), np.repeat(diff[:, k], wide), len(names) + 1) for k in range(3)], 1) / len(data) + decay * w
        gw[-1] = 0
        gs = (q.sum((0, 1)) - pairs) / len(data) + decay * s
        for value, grad, m, v in ((w, gw, moments[0], moments[1]), (s, gs, moments[2], moments[3])):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field({name: w[i] for i, name in enumerate(names)}, s)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """Train on windows of at most ``sample`` documents, the first by hash of id and then of text; texts stay in the tasks."""
    rows = docs.select(F.col("text").cast("string").alias("text"), F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("t")).where(F.length("text") > 0)
    last = rows.select("h", "t").orderBy("h", "t").limit(sample).agg(F.max(F.struct("h", "t"))).first()[0]
    if last is None:
        return fit_windows([])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [json.dumps(labelled_windows(text, t & 0xFFFFFFFF)) for text, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(found, pa.string())], ["h", "t", "windows"])

    chosen = rows.where((F.col("h") < last["h"]) | ((F.col("h") == last["h"]) & (F.col("t") <= last["t"]))).mapInArrow(run, "h long, t long, windows string")
    lists = [r["windows"] for r in chosen.orderBy("h", "t").limit(sample).collect()]
    return fit_windows([(rows_, tags) for text in lists for rows_, tags in json.loads(text)])


# ---------------------------------------------------------------- scans


def all_spans(text: str, field: Field, touching: bool = False) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and base and field spans; with ``touching`` also the tagged runs that touch a base span."""
    base = base_spans(text)
    tokens = TOKEN.findall(text)
    runs = field.tag(tokens, text) if tokens else []
    more = []
    if runs:
        places = [m.span() for m in TOKEN.finditer(text)]
        for i, j in runs:
            a, b = places[i][0], places[j - 1][1]
            if touching or not any(x < b and a < y for x, _, y in base):
                more.append((a, 3, b))
    return base, base + more


RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, base counts, base_sha256 and spans of each row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(field or fit(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                base, spans = all_spans(text.as_py() or "", shared.value)
                kinds = [k for _, k, _ in base]
                rows.append((doc_id, kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.string()] * 2, strict=True)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, RESULT)


def redacted(text: str | None, field: Field, mark: str) -> str | None:
    """``text`` with ``mark`` in the place of its spans; spans that overlap are one."""
    _, spans = all_spans(text, field, touching=True) if text else ([], [])
    if not spans:
        return text
    at, parts = 0, []
    for a, _, b in sorted(spans):
        if a >= at:
            parts += [text[at:a], mark]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, field: Field | None = None, mark: str = "[SECRET]") -> DataFrame:
    """``docs``, all columns, with every span of ``text`` replaced by ``mark`` and ``n_chars``, if present, counted anew.

    Of a tagged run that a base span covers in part the rest goes as well.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field or fit(docs))
    names, schema = docs.columns, T.StructType(docs.schema.fields)
    place = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            cut = list(texts)
            for i, text in enumerate(texts):
                cut[i] = redacted(text, shared.value, mark)
            cols = list(batch.columns)
            cols[place] = pa.array(cut, batch.column(place).type)
            if "n_chars" in names:
                k = names.index("n_chars")
                old = cols[k].to_pylist()
                cols[k] = pa.array([n if c is None or c == t else len(c) for n, c, t in zip(old, cut, texts, strict=True)], batch.column(k).type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(run, schema)
