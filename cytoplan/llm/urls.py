"""URL filters: domain rules, and pattern rules indexed by their rarest literal token.

A domain rule is a host and the beginning of a path; it fits the host and all its subdomains, and of those that fit the longest decides
(ties: the longer host). URLs without such a rule are judged by pattern rules, written in the notation of filter lists: ``||`` begins at
a label of the host, ``|`` at an end of the URL, ``*`` is anything, ``^`` a separator or the end, ``/.../`` a regular expression,
``@@`` an exception. A URL is blocked if a pattern fits it and no exception does.

Each pattern is kept under one literal token (a run of a-z and 0-9 that every URL it fits has whole): of its tokens the one that is
rarest among the tokens of all URLs, which Spark counts first. The tokens of a URL fetch the candidates, and only their regular
expressions run. Patterns without a token run on every URL.

The index is a constant of at most INDEX_BYTES in the row's expression, hashed into buckets: no shuffle, no join. A longer list becomes a
table that the tokens of the URLs join; results are the same. Everything is built-in column functions; no Python worker runs.

Edge cases. A null URL, or one without ``://``, has an empty host and path and no domain rule; patterns see its text (null: none) and
allow it if none fits. Ports and user names belong to the host. Letters beyond A-Z keep their case. Repeated rows give repeated results, an empty table gives none, a null
page_id stays null; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The domain rules of the contract.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
# Names of unwanted hosts, paths and parameters.
PATTERNS = """
||ads-track. ||adserver. ||ads. ||ad. ||banner. ||doubleclick. ||tracker. ||tracking. ||pixel.
||casino-*. ||casino. ||poker. ||free-bets. ||betting. ||slots. ||jackpot.
||adult-*. ||adult. ||xxx. ||porn. ||sex.
||cheap-pills. ||pills. ||viagra. ||pharmacy-*.
||spam-farm. ||spam. ||link-farm. ||payday-*. ||warez. ||torrent.
/ads/ /adserver/ /banners/ /popunder/ /sponsored/ /affiliate/ /doorway/ /linkfarm/ /tracking/pixel
/click?url= &affid= ?affid= ^aff_id=
/^[a-z]+:\\/\\/[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+[\\/:]/
/\\/wp-login\\.php/ /\\/xmlrpc\\.php/
@@||example.edu^ @@/ads/policy @@||*.gov^
""".split()

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of index in a row's expression; longer lists are joined.
INDEX_BYTES = 8 << 20
TOKEN = "a-z0-9"
_BETWEEN = f"[^{TOKEN}]+"
_SEPARATOR = r"([^a-z0-9_.%-]|\z)"
_HOST = r"\A[^:/?#]*://([^/?#]*[.@])?"


@dataclass(frozen=True)
class Pattern:
    text: str
    regex: str
    tokens: tuple[str, ...]
    exception: bool


def _regex_tokens(body: str) -> list[str]:
    """Tokens that every match of a regular expression holds whole: literal runs outside of groups between literal separators."""
    found, run, clean, depth, i = [], "", False, 0, 0
    while i < len(body):
        c = body[i]
        step = 2 if c == "\\" and i + 1 < len(body) else 1
        literal = body[i + 1] if step == 2 and not body[i + 1].isalnum() else c if step == 1 and (c.isascii() and c.isalnum() or c in "/-_=&:,;%~@!") else None
        loose = body[i + step : i + step + 1] in ("?", "*", "+", "{")
        if c == "[" and step == 1:
            close = body.find("]", i + 2)
            i, run, clean = (close if close > 0 else len(body)) + 1, "", False
            continue
        if c == "|" and depth == 0 and step == 1:
            return []
        depth += (c == "(") - (c == ")") if step == 1 else 0
        if depth or literal is None:
            run, clean = "", False
        elif literal.isalnum():
            run, clean = ("", False) if loose else (run + literal.lower(), clean)
        else:
            if run and clean and not loose:
                found.append(run)
            run, clean = "", not loose
        i += step
    return found


def compiled(text: str) -> Pattern:
    """A pattern's regular expression, which Java and RE2 read alike, for URLs with A-Z in lower case, and its literal tokens."""
    exception = text.startswith("@@")
    body = text[2:] if exception else text
    if len(body) > 2 and body[0] == body[-1] == "/" and re.search(r"[\\\[(|]", body):
        return Pattern(text, f"(?s){body[1:-1]}", tuple(_regex_tokens(body[1:-1])), exception)
    body = body.lower()
    head = "||" if body.startswith("||") else "|" if body.startswith("|") else ""
    tail = "|" if len(body) > len(head) and body.endswith("|") else ""
    core = body[len(head) : len(body) - len(tail)]
    # Separators and anchors bound a token as literal marks do; a star or an open end does not.
    shown = ("/" if head else "*") + core.replace("^", "/") + ("/" if tail else "*")
    tokens = tuple(m[0] for m in re.finditer(f"[{TOKEN}]+", shown) if "*" not in (shown[m.start() - 1], shown[m.end()]))
    regex = "".join(".*" if c == "*" else _SEPARATOR if c == "^" else re.escape(c) if c.isascii() else c for c in core)
    return Pattern(text, "(?s)" + {"||": _HOST, "|": r"\A", "": ""}[head] + regex + (r"\z" if tail else ""), tokens, exception)


def lowered(url: Column) -> Column:
    return F.translate(url, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    after = F.coalesce(after, F.lit(""))
    host = F.regexp_extract(after, r"\A[^/?#]*", 0)
    return lowered(host), F.regexp_extract(F.substring(after, F.length(host) + 1, F.length(after)), r"\A[^?#]*", 0)


def _tokens(url: Column) -> Column:
    """Distinct tokens of a lower-cased URL; the empty one stands for patterns without a token."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(F.coalesce(url, F.lit("")), _BETWEEN)))


def token_counts(pages: DataFrame, tokens: set[str]) -> dict[str, int]:
    """How many URLs have each of ``tokens``, counted over all pages; as many rows as the rule list has tokens, at most."""
    each = pages.select(F.explode(_tokens(lowered(F.col("url").cast("string")))).alias("token"))
    return {r["token"]: r["n"] for r in each.where(F.col("token").isin(sorted(tokens))).groupBy("token").agg(F.count("*").alias("n")).collect()} if tokens else {}


def indexed(pages: DataFrame, patterns: list[Pattern]) -> list[tuple[str, Pattern]]:
    """Each pattern with the token that it is kept under: the rarest, then the longest, then the smallest; none: the empty one."""
    counts = token_counts(pages, {t for p in patterns for t in p.tokens})
    return [(min(p.tokens, key=lambda t: (counts.get(t, 0), -len(t), t), default=""), p) for p in patterns]


_ENTRY = "struct<token: string, text: string, regex: string, exception: boolean>"


def _entries(index: list[tuple[str, Pattern]]) -> list[dict]:
    return [{"token": token, "text": p.text, "regex": p.regex, "exception": p.exception} for token, p in index]


def _constant(value: object, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def _in_row(url: Column, entries: list[dict]) -> Column:
    """The patterns that fit, found by way of a constant index of buckets."""
    buckets: list[list[dict]] = [[] for _ in range(max(1, 2 * len(entries)))]
    for e in entries:
        buckets[zlib.crc32(e["token"].encode()) % len(buckets)].append(e)
    held = _constant(buckets, f"array<array<{_ENTRY}>>")
    fetched = F.flatten(F.transform(_tokens(url), lambda t: F.filter(F.get(held, F.pmod(F.crc32(t.cast("binary")), F.lit(len(buckets))).cast("int")), lambda e: e["token"] == t)))
    return F.filter(fetched, lambda e: F.rlike(F.coalesce(url, F.lit("")), e["regex"]))


def _by_join(pages: DataFrame, entries: list[dict]) -> DataFrame:
    """``pages`` (page_id, url, low) with ``fits`` by way of a join of tokens with the index as a table."""
    spark = pages.sparkSession
    held = spark.createDataFrame([(e["token"], e["text"], e["regex"], e["exception"]) for e in entries], "token string, text string, regex string, exception boolean")
    urls = pages.select(F.coalesce("low", F.lit("")).alias("key")).distinct().select("key", F.explode(_tokens(F.col("key"))).alias("token"))
    hits = urls.join(held, "token").where(F.rlike("key", "regex"))
    hits = hits.groupBy("key").agg(F.collect_list(F.struct("token", "text", "regex", "exception")).alias("fits"))
    return pages.join(hits, F.coalesce("low", F.lit("")) == F.col("key"), "left").withColumn("fits", F.coalesce("fits", F.array().cast(f"array<{_ENTRY}>"))).drop("key")


def _domain_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The rule (struct of rule and verdict) that decides, or null. The suffixes of a host fetch its rules from buckets."""
    listed = [{"host": r.partition("/")[0], "path": r[len(r.partition("/")[0]) :], "rule": r, "verdict": v, "size": len(r)} for v, r in rules]
    buckets: list[list[dict]] = [[] for _ in range(max(1, 2 * len(listed)))]
    for r in listed:
        buckets[zlib.crc32(r["host"].encode()) % len(buckets)].append(r)
    held = _constant(buckets, "array<array<struct<host: string, path: string, rule: string, verdict: string, size: int>>>")
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    fetched = F.flatten(F.transform(suffixes, lambda s: F.filter(F.get(held, F.pmod(F.crc32(s.cast("binary")), F.lit(len(buckets))).cast("int")), lambda r: (r["host"] == s) & path.startswith(r["path"]))))
    ranked = F.transform(fetched, lambda r: F.struct(r["size"].alias("size"), F.length(r["host"]).alias("width"), r["rule"].alias("rule"), r["verdict"].alias("verdict")))
    return F.array_max(ranked)


def judge(pages: DataFrame, rules: list[tuple[str, str]] | None = None, patterns: list[str] | None = None, most: int = INDEX_BYTES) -> DataFrame:
    """page_id, host, path, rule (null if none fits), verdict (allow or block), pattern (the first in order that blocks, if one decides)."""
    known = [compiled(p) for p in dict.fromkeys(PATTERNS if patterns is None else patterns)]
    entries = _entries(indexed(pages, known))
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), lowered(url).alias("low"))
    if len(json.dumps(entries)) <= most:
        rows = rows.withColumn("fits", _in_row(F.col("low"), entries))
    else:
        rows = _by_join(rows, entries)
    host, path = host_and_path(F.col("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"), F.when(~F.exists("fits", lambda e: e["exception"]), F.array_min(F.transform("fits", lambda e: e["text"]))).alias("pattern"))
    rows = rows.withColumn("found", _domain_rule(F.col("host"), F.col("path"), RULES if rules is None else rules))
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("pattern").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return rows.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), F.when(F.col("found").isNull(), F.col("pattern")).alias("pattern"))


def judge_sql() -> str:
    """The same in DuckDB: every rule and every pattern on every URL."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rules = ", ".join(f"({quoted(v)}, {quoted(r)}, {quoted(r.partition('/')[0])}, {quoted(r[len(r.partition('/')[0]) :])})" for v, r in RULES)
    patterns = ", ".join(f"({quoted(p.text)}, {quoted(p.regex)}, {str(p.exception).lower()})" for p in map(compiled, dict.fromkeys(PATTERNS)))
    return f"""
WITH rules(verdict, rule, h, p) AS (VALUES {rules}), pats(pattern, regex, exc) AS (VALUES {patterns}),
base AS (SELECT row_number() OVER () AS id, page_id, url, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS low,
  CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
cut AS (SELECT *, regexp_extract(rest, '\\A[^/?#]*') AS h0 FROM base),
urls AS (SELECT id, page_id, low, translate(h0, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(h0) + 1), '\\A[^?#]*') AS path FROM cut),
best AS (SELECT id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM urls, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY id),
hits AS (SELECT id, min(pattern) AS pattern FROM urls, pats WHERE regexp_matches(low, regex) GROUP BY id HAVING NOT bool_or(exc))
SELECT CAST(page_id AS BIGINT) AS page_id, host, path, rule, coalesce(verdict, CASE WHEN pattern IS NULL THEN 'allow' ELSE 'block' END) AS verdict, CASE WHEN rule IS NULL THEN pattern END AS pattern
FROM urls LEFT JOIN best USING (id) LEFT JOIN hits USING (id)
"""
