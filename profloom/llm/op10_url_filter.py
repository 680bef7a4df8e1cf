"""URL filters: a bit-parallel wildcard automaton over canonical URLs.

Every glob rule (``*`` any run, ``?`` any byte) becomes a stretch of bits in one
multiword Shift-And state. One pass over a URL's bytes moves all rules at once;
the pass is vectorised over the URLs of an Arrow batch, so Python pays per byte
position of the longest URL and not per URL or rule.

Defined cases: a null URL, or one without ``://``, has empty host and path, no rule,
and the default verdict. Bytes that stand for the separator in the canonical form
cannot be smuggled in by a URL: they are replaced first. Repeated rows are judged
alike; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profloom.llm.common import U64, table

#: Stands between host and path in the canonical form ``.host SEP path``.
SEP = "\x01"

#: Fixed values: (verdict, host, path) of the site rules, the longest that fits wins.
SITE_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Globs over the canonical form that block a URL to which no site rule applies.
DEFAULT_BLOCK_GLOBS = (f"*.spam*{SEP}*", f"*casino*{SEP}*", f"*{SEP}*/wp-admin/*", f"*{SEP}*.exe")


@dataclass(frozen=True)
class Automaton:
    """Shift-And masks: state bit j of a rule is set while its first j literals have matched."""

    words: int
    steps: np.ndarray  # [256, words]: bits that byte c may enter
    loops: np.ndarray  # [words]: bits that any byte keeps (a * follows)
    start: np.ndarray  # [words]
    final: np.ndarray  # one (word, bit) per rule


def compile_globs(globs: tuple[str, ...]) -> Automaton:
    parsed = []
    for glob in globs:
        literals, stars = [], set()
        for c in glob.encode():
            if c == ord("*"):
                stars.add(len(literals))
            else:
                literals.append(c)
        parsed.append((literals, stars))
    words = max(1, -(-sum(len(x) + 1 for x, _ in parsed) // 64))
    steps, loops, start = (np.zeros(s, U64) for s in ((256, words), words, words))
    final, at = [], 0
    for literals, stars in parsed:
        start[at // 64] |= U64(1 << at % 64)
        for j in range(len(literals) + 1):
            w, bit = divmod(at + j, 64)
            if j in stars:
                loops[w] |= U64(1 << bit)
            if j:
                c = literals[j - 1]
                steps[slice(None) if c == ord("?") else c, w] |= U64(1 << bit)
        final.append(divmod(at + len(literals), 64))
        at += len(literals) + 1
    return Automaton(words, steps, loops, start, np.array(final, np.int64).reshape(-1, 2))


#: URLs that one vectorised pass takes.
CHUNK = 16384


def run_automaton(machine: Automaton, texts: list[bytes]) -> np.ndarray:
    """[text, rule] booleans: does the whole text match the whole glob?"""
    hit = np.zeros((len(texts), len(machine.final)), bool)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    order = np.argsort(-lengths, kind="stable")  # those still running stay in front
    for lo in range(0, len(order), CHUNK):
        rows = order[lo : lo + CHUNK]
        size = lengths[rows]
        flat = np.frombuffer(b"".join(texts[i] for i in rows), np.uint8)
        begin = np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64)
        state = np.repeat(machine.start[None, :], len(rows), 0)
        live = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")
        for i, k in enumerate(live):
            now = state[:k]
            moved = now << U64(1)
            moved[:, 1:] |= now[:, :-1] >> U64(63)
            state[:k] = (moved & machine.steps[flat[begin[:k] + i]]) | (now & machine.loops)
        hit[rows] = (state[:, machine.final[:, 0]] >> machine.final[:, 1].astype(U64)) & U64(1) != 0
    return hit


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path); both empty for a null URL or one without ``://``."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    ends = [i for c in "/?#" if (i := rest.find(c)) >= 0]
    cut = min(ends, default=len(rest))
    host = rest[:cut].translate(_LOWER)
    tail = rest[cut:]
    path_end = min((i for c in "?#" if (i := tail.find(c)) >= 0), default=len(tail))
    return host, tail[:path_end]


_LOWER = {c: c + 32 for c in range(65, 91)}


def url_filter(
    df: DataFrame, id_col: str, url_col: str, rules: tuple = SITE_RULES, default_globs: tuple = DEFAULT_BLOCK_GLOBS, default: str = "allow"
) -> DataFrame:
    """(id, host, path, rule, verdict, globs) per row.

    ``rule`` is the longest site rule that fits (null: none), ``globs`` the positions of the
    default globs that matched. Where no site rule fits, any matching glob blocks.
    """
    ranked = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    machine = compile_globs(tuple(f"*.{host}{SEP}{path}*" for _, host, path in ranked) + tuple(default_globs))
    names = [host + path for _, host, path in ranked]
    verdicts = [verdict for verdict, _, _ in ranked]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            hit = run_automaton(machine, [f".{h.replace(SEP, '\x02')}{SEP}{p.replace(SEP, '\x02')}".encode("utf-8", "surrogatepass") for h, p in parts])
            if parts:
                hit[[i for i, (h, p) in enumerate(parts) if not h and not p]] = False
            site, other = hit[:, : len(names)], hit[:, len(names) :]
            first = np.where(site.any(1), site.argmax(1) if names else 0, -1)
            blocked = other.any(1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([h for h, _ in parts], pa.string()),
                    pa.array([p for _, p in parts], pa.string()),
                    pa.array([names[k] if k >= 0 else None for k in first], pa.string()),
                    pa.array([verdicts[k] if k >= 0 else "block" if b else default for k, b in zip(first, blocked, strict=True)], pa.string()),
                    pa.array([np.flatnonzero(row).tolist() for row in other], pa.list_(pa.int32())),
                ],
                ["id", "host", "path", "rule", "verdict", "globs"],
            )

    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(judge, f"id {kind}, host string, path string, rule string, verdict string, globs array<int>")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_filter(table(spark, sf_dir, "pages"), "page_id", "url")
    return found.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


ORACLE = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN '' ELSE substr(url, position('://' IN url) + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM cut
), rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fits AS (
  SELECT page_id, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC) AS k
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT p.page_id, p.host, p.path, f.rule,
       coalesce(f.verdict, CASE WHEN ('.' || p.host) LIKE '%.spam%' OR p.host LIKE '%casino%' OR p.path LIKE '%/wp-admin/%' OR p.path LIKE '%.exe'
                                THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id AND f.k = 1
"""
