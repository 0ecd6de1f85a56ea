"""URL filters: pattern rules indexed by their rarest literal token.

Every rule has a regular expression over host + path and the literal tokens that any fitting URL must
hold as whole tokens. One pass counts, over all URLs, how many hold each of the rules' tokens; a rule
is indexed under the rarest of its own. A second pass cuts each URL into tokens, fetches the rules
indexed under them, and runs only those expressions; rules without a sure token are always run.

Rules are taken in blocks of `BLOCK`, each a pass of the same map over what the blocks before it found, so
what a task holds is bounded whatever the number of rules; an expression is compiled when a URL first
fetches it. Token counts are added up by the only shuffle.

Edge cases: a null URL, or one without ``://``, has empty host and path and gets the default verdict;
an empty path fits only rules without a path; longest fitting rule wins, the first given on a tie;
very long URLs are cut into tokens whole; repeated rows are judged each for itself; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkstream.llm.common import small_batches

BLOCK = 100_000  # rules of a pass
TOKEN = re.compile("[a-z0-9]+")
_LOWER = {i: i + 32 for i in range(65, 91)}


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str  # allow or block
    pattern: str  # matched from the start of host + path
    tokens: tuple[str, ...] = ()
    listed: bool = True  # False: one of the method's own patterns, weaker than any listed rule


def host_rule(name: str, verdict: str) -> Rule:
    """`host/path`: fits the host and its subdomains where the URL's path starts with the rule's."""
    host, slash, path = name.partition("/")
    bounded = TOKEN.findall(host.lower())
    parts = re.split("[^A-Za-z0-9]+", slash + path)
    bounded += [t.lower() for t in parts[:-1] if t]  # the last one may go on in the URL
    return Rule(name, verdict, rf"(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + path)}", tuple(bounded))


def host_word(word: str) -> Rule:
    """Blocks hosts that hold `word` between dots or hyphens."""
    return Rule(word, "block", rf"(?:[^/]*[.-])?{re.escape(word)}(?:[.-]|/|$)", tuple(TOKEN.findall(word)), listed=False)


def path_word(word: str) -> Rule:
    """Blocks paths that hold `word` between slashes, dots, hyphens or underscores."""
    return Rule(f"/{word}", "block", rf"[^/]*/(?:.*[/._-])?{re.escape(word)}(?:[/._-]|$)", tuple(TOKEN.findall(word)), listed=False)


def file_kind(kind: str) -> Rule:
    """Blocks paths that end in a file of this kind."""
    return Rule(f".{kind}", "block", rf"[^/]*/.*\.(?i:{re.escape(kind)})$", (kind,), listed=False)


#: Fixed values of the query contract.
LISTED = (host_rule("net/", "block"), host_rule("example.net/en/", "allow"), host_rule("example.com/de/", "block"), host_rule("org/fr/", "allow"))
#: What this method blocks by itself: words of hosts and paths, programs, numeric hosts and hosts in disguised letters.
WORDS = ("adult", "bets", "casino", "malware", "phishing", "porn", "spam", "torrent", "warez", "xxx")
PATH_WORDS = ("casino", "malware", "phishing", "porn", "torrent", "warez")
KINDS = ("apk", "exe", "msi", "scr")
NUMERIC = Rule("numeric host", "block", r"(?:[^/]*@)?[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]*)?(?:/|$)", listed=False)
PUNYCODE = Rule("xn--", "block", r"(?:[^/]*\.)?xn--", ("xn",), listed=False)
OWN = (*map(host_word, WORDS), *map(path_word, PATH_WORDS), *map(file_kind, KINDS), NUMERIC, PUNYCODE)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    ends = min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    host, slash, path = rest[:ends].partition("/")
    return host.lower() if host.isascii() else host.translate(_LOWER), slash + path


def token_counts(pages: DataFrame, rules: tuple[Rule, ...], url_col: str = "url") -> dict[str, int]:
    """How many of all URLs hold each of the rules' tokens (as many rows as the rules have tokens)."""
    wanted = sorted({t for r in rules for t in r.tokens})
    held = F.array_distinct(F.filter(F.split(F.lower(F.col(url_col)), "[^a-z0-9]+"), lambda t: t.isin(wanted)))
    counted = pages.select(F.explode(held).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return {r.token: r.n for r in counted.collect()}


def index_rules(rules: tuple[Rule, ...], counts: dict[str, int]) -> dict[str, list[int]]:
    """Numbers of rules by their rarest token; those without one under the empty token."""
    index = defaultdict(list)
    for i, r in enumerate(rules):
        index[min(r.tokens, key=lambda t: (counts.get(t, 0), t), default="")].append(i)
    return dict(index)


def _rank(rule: Rule, number: int) -> tuple[bool, int, int]:
    return rule.listed, len(rule.name), -number


def _pass(rules: tuple[Rule, ...], index: dict[str, list[int]], first: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map of id, url, host, path, best (listed, length, -number, name, verdict) and n_tried that tries one block of rules."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled: dict[int, re.Pattern] = {}

        def fits(i: int, whole: str) -> bool:
            if i not in compiled:
                compiled[i] = re.compile(rules[i].pattern)
            return compiled[i].match(whole) is not None

        for batch in batches:
            hosts, paths, best, tried = [], [], batch["best"].to_pylist(), batch["n_tried"].to_pylist()
            for k, url in enumerate(batch["url"].to_pylist()):
                host, path = split_url(url)
                hosts.append(host)
                paths.append(path)
                whole = host + path
                near = {i for t in {*TOKEN.findall(whole.lower()), ""} for i in index.get(t, ())}
                tried[k] += len(near)
                held = best[k] and (best[k]["listed"], best[k]["length"], best[k]["order"])
                for i in near:
                    rank = _rank(rules[i], first + i)
                    if (held is None or rank > held) and fits(i, whole):
                        held = rank
                        best[k] = {"listed": rank[0], "length": rank[1], "order": rank[2], "name": rules[i].name, "verdict": rules[i].verdict}
            columns = [batch["id"], batch["url"], pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(best, batch["best"].type), pa.array(tried, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "url", "host", "path", "best", "n_tried"])

    return run


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = LISTED + OWN, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, pattern (the rule that decided, listed or own), n_tried."""
    kind = pages.schema[id_col].dataType.simpleString()
    best = "struct<listed:boolean,length:int,order:long,name:string,verdict:string>"
    rows = small_batches(pages).select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.lit("").alias("host"), F.lit("").alias("path"), F.lit(None).cast(best).alias("best"), F.lit(0).alias("n_tried"))
    for first in range(0, max(len(rules), 1), BLOCK):
        block = rules[first : first + BLOCK]
        index = index_rules(block, token_counts(pages, block, url_col))
        rows = rows.mapInArrow(_pass(block, index, first), f"id {kind}, url string, host string, path string, best {best}, n_tried int")
    listed = F.when(F.col("best.listed"), F.col("best.name")).alias("rule")
    return rows.select(F.col("id").alias("page_id"), "host", "path", listed, F.coalesce("best.verdict", F.lit(default)).alias("verdict"), F.col("best.name").alias("pattern"), "n_tried")
