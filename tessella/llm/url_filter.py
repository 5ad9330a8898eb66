"""URL filtering by one bit-parallel wildcard automaton.

Every glob rule is packed into the same multiword bit vector, and an extended
Shift-And step advances all rules over a batch of canonical URLs at once.
A glob's bits are one start state and one state per literal; a ``*`` (any run
of characters but ``/``) or ``**`` (any run) keeps the state before it alive on
the bytes it may read. One step on byte c is ``D = ((D << 1) & B[c]) | (D & L[c])``.

The canonical URL is ``.`` + host + path, so ``*.`` in front of a host covers it
and its subdomains, and ``*`` cannot leave the host.

Defined results: a null URL, or one without ``://``, has empty host and path, no
rule, and the verdict that the method's own globs give to the empty address
(allow). URLs are read whole; one is advanced byte by byte, so a batch takes as
many steps as its longest URL has bytes, each over the URLs that still go on. Of
rules that are equally long the first one listed decides; two that fit one URL
cannot be equally long unless they are equal. Repeated rows get equal answers; an
empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import LOWER, UPPER, table

#: (host, path, verdict); of the rules that fit a URL the longest decides.
HOST_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

#: The method's own globs over host and path; one that fits blocks a URL that no host rule decides.
BLOCKED_GLOBS = [
    "*.xxx/**", "*.casino/**", "ads.*/**", "adserver.*/**", "tracker.*/**", "doubleclick.*/**",
    "*/**/wp-login*", "*/**/wp-admin/**", "*/**/cgi-bin/**", "*/**/adclick*", "*/**/banner/**",
    "*/**/cart/**", "*/**/checkout/**", "*/**/login/**", "*/**/signup/**",
    "*/**.exe", "*/**.zip", "*/**.tar.gz", "*/**.iso", "*/**.apk", "*/**.dmg",
    "*/**porn*/**", "*/**viagra*", "*/**casino*",
]

#: The same subjects where the globs above miss them: at the root of a host, without a path or behind a port,
#: as the path's last part or before further parts. ORACLE_SQL states BLOCKED_GLOBS alone.
PLAIN_GLOBS = [
    "*.xxx", "*.xxx:*", "*.xxx:*/**", "*.casino", "*.casino:*", "*.casino:*/**", "ads.*", "adserver.*", "tracker.*", "doubleclick.*",
    "*/wp-login*", "*/adclick*", "**/wp-login*/**", "**/adclick*/**",
    *(g for word in ("wp-admin", "cgi-bin", "banner", "cart", "checkout", "login", "signup") for g in (f"*/{word}/**", f"**/{word}")),
    "*/**porn*", "*/**viagra*/**", "*/**casino*/**",
]


def tokens(glob: str) -> list[tuple[str, str]]:
    """(kind, byte char): kind is 'lit', 'one' (``?``), 'run' (``*``) or 'any' (``**``)."""
    out, at = [], 0
    while at < len(glob):
        if glob.startswith("**", at):
            out.append(("any", ""))
            at += 2
        elif glob[at] == "*":
            out.append(("run", ""))
            at += 1
        elif glob[at] == "?":
            out.append(("one", ""))
            at += 1
        else:
            out += [("lit", bytes([b])) for b in glob[at].encode()]
            at += 1
    return out


@dataclass
class GlobAutomaton:
    """Step tables of all globs: 256 x words of 64 states."""

    advance: np.ndarray
    stay: np.ndarray
    start: np.ndarray
    accept: list[tuple[int, int]]

    @classmethod
    def build(cls, globs: list[str]) -> GlobAutomaton:
        parsed = [tokens(g) for g in globs]
        states = sum(1 + sum(k in ("lit", "one") for k, _ in p) for p in parsed)
        words = max(1, (states + 63) // 64)
        advance, stay = np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64)
        start, accept, bit = np.zeros(words, np.uint64), [], 0
        slash = ord("/")

        def put(rows: np.ndarray, which, at: int) -> None:
            rows[which, at // 64] |= np.uint64(1) << np.uint64(at % 64)

        others = np.array([b for b in range(256) if b != slash])
        for p in parsed:
            start[bit // 64] |= np.uint64(1) << np.uint64(bit % 64)
            for kind, byte in p:
                if kind == "any":
                    put(stay, slice(None), bit)
                elif kind == "run":
                    put(stay, others, bit)
                else:
                    bit += 1
                    put(advance, others if kind == "one" else byte[0], bit)
            accept.append((bit // 64, bit % 64))
            bit += 1
        return cls(advance, stay, start, accept)

    def fits(self, texts: list[bytes]) -> np.ndarray:
        """Boolean matrix, texts by globs: does the glob fit the whole text?"""
        n = len(texts)
        sizes = np.fromiter((len(t) for t in texts), np.int64, n)
        order = np.argsort(-sizes, kind="stable")
        flat = np.frombuffer(b"".join(texts[i] for i in order), dtype=np.uint8)
        ends = np.cumsum(sizes[order])
        begins = ends - sizes[order]
        state = np.tile(self.start, (n, 1))
        live = np.searchsorted(-sizes[order], -np.arange(1, (sizes.max() if n else 0) + 1), side="right")
        one, top = np.uint64(1), np.uint64(63)
        for step, count in enumerate(live):
            byte = flat[begins[:count] + step]
            now = state[:count]
            moved = now << one
            if moved.shape[1] > 1:
                moved[:, 1:] |= now[:, :-1] >> top
            state[:count] = (moved & self.advance[byte]) | (now & self.stay[byte])
        out = np.empty((n, len(self.accept)), dtype=bool)
        for k, (word, bit) in enumerate(self.accept):
            out[order, k] = (state[:, word] >> np.uint64(bit)) & one
        return out


def address_columns(url: str = "url"):
    """Host and path of a URL column; both empty without ``://``."""
    rest = F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def filtered_urls(
    pages: DataFrame,
    keep: tuple[str, ...] = (),
    url: str = "url",
    rules: list[tuple[str, str, str]] = HOST_RULES,
    globs: list[str] = BLOCKED_GLOBS + PLAIN_GLOBS,
) -> DataFrame:
    """(keep..., host, path, rule, verdict) of each row."""
    by_length = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    automaton = GlobAutomaton.build([f"*.{h}{p}**" for h, p, _ in by_length] + [f"*.{g}" if not g.startswith("*") else g for g in globs])
    named = [(h + p, v) for h, p, v in by_length]
    host, path = address_columns(url)
    rows = pages.select(*keep, host.alias("host"), path.alias("path"))

    def run(batches):
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            fits = automaton.fits([f".{h}{p}".encode() for h, p in zip(hosts, paths)])
            rule, verdict = [], []
            for row in fits:
                first = next((named[k] for k in range(len(named)) if row[k]), None)
                rule.append(first[0] if first else None)
                verdict.append(first[1] if first else "block" if row[len(named) :].any() else "allow")
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), batch.column("host"), batch.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                [*keep, "host", "path", "rule", "verdict"],
            )

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields if f.name in keep)
    return rows.mapInArrow(run, fields + "host string, path string, rule string, verdict string")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered_urls(table(spark, sf_dir, "pages").select("page_id", "url"), keep=("page_id",))


def glob_regex(glob: str) -> str:
    """The same glob as an RE2 pattern over ``.`` + host + path."""
    said = {"any": "(?:.|\\n)*", "run": "[^/]*", "one": "[^/]"}
    return "".join(said.get(k) or ("\\" + b.decode() if not b.isalnum() else b.decode()) for k, b in tokens(glob))


def _sql() -> str:
    quote = lambda s: s.replace("'", "''")
    fit = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    longest = sorted(HOST_RULES, key=lambda r: -len(r[0] + r[1]))
    rule = " ".join(f"WHEN {fit(h, p)} THEN '{h}{p}'" for h, p, _ in longest)
    verdict = " ".join(f"WHEN '{h}{p}' THEN '{v}'" for h, p, v in longest)
    own = "|".join(f"(?:{glob_regex(g if g.startswith('*') else '*.' + g)})" for g in BLOCKED_GLOBS)
    return f"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), addresses AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), ruled AS (
  SELECT page_id, host, path, CASE {rule} ELSE NULL END AS rule FROM addresses
)
SELECT page_id, host, path, rule,
       CASE rule {verdict} ELSE CASE WHEN regexp_full_match('.' || host || path, '{quote(own)}') THEN 'block' ELSE 'allow' END END AS verdict
FROM ruled
"""


ORACLE_SQL = _sql()
