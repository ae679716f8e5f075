"""URL filters: rules first, then the reputation of the host by empirical Bayes.

Labelled outcomes of pages are counted by host. The share of bad pages of a host is beta-distributed around that of its
registered domain, the domain's around that of its suffix, the suffix's around that of all pages. How strongly a level follows the one
above is estimated from the counts: for groups of n outcomes with y bad ones around an expected share m, the sum of
(y - nm)^2 - nm(1-m) over the sum of n(n-1)m(1-m) is the correlation within groups, and 1/correlation - 1 is the weight of the
prior in outcomes. So a host with few outcomes is judged by its domain, and one without any by its domain alone. A host is blocked
if the lower bound of its posterior share of bad pages (at BOUND_Z standard errors on the logit scale) is over THRESHOLD.

All of it is built-in functions. Outcomes are counted by (host, document) before they meet labels and by host before anything
else, so a host with a third of all pages is one row; levels are joined back by key, their estimates by scalar subqueries.

Cases: a null url, or one without ``://``, has the empty host and path; it has no rule and the reputation of the empty host. Ports and
user names are part of the host as it stands; they are left out where domains are cut. A page without a known outcome counts
nowhere; labels that are null or repeated count as they stand. Repeated pages stay. An empty table gives an empty result; without
any outcome the share is PRIOR. Columns other than the id and the url are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillmark.llm.manifest import ascii_lower
from tillmark.operators.joins import beside_scalars

THRESHOLD, BOUND_Z, PRIOR = 0.5, 1.645, 0.1
#: Correlation within groups is held in these bounds: a prior weighs 1 to 999 outcomes.
CORRELATION = (0.001, 0.5)

# Suffixes of two parts under which domains are registered.
SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "com.cn", "gov.uk", "net.au", "org.au", "org.nz", "org.uk")

#: (verdict, host, path)
Rule = tuple[str, str, str]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands after the first ``://`` up to a slash, a question mark, a hash or the end; and from there up to one of the latter two."""
    start = F.locate("://", url)
    rest = F.when(start > 0, F.substring(url, start + 3, F.char_length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)), F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """A struct (rule, verdict) of the longest of ``rules`` that fits, else null. The rules become part of the plan: a short list."""
    fits = [
        F.when(
            ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)),
            F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict")),
        )
        for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    ]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def domain_and_suffix(host: Column, suffixes: Sequence[str] = SUFFIXES) -> tuple[Column, Column]:
    """The registered domain and the suffix it is registered under; an address of numbers is both."""
    name = F.regexp_replace(F.regexp_replace(host, r"\A.*@", ""), r":\d*\z|\.\z", "")
    last = F.substring_index(name, ".", -2)
    listed = last.isin(*suffixes) if suffixes else F.lit(False)
    numbers = name.rlike(r"\A(\d+(\.\d+){3}|\[.*\]?)\z")
    suffix = F.when(numbers, name).when(listed, last).otherwise(F.substring_index(name, ".", -1))
    domain = F.when(numbers, name).when(listed, F.substring_index(name, ".", -3)).otherwise(last)
    return domain, suffix


def _weight(groups: DataFrame, expected: str) -> DataFrame:
    """One row: the weight of the prior share ``expected`` for groups (n, bad), in outcomes."""
    m = F.col(expected)
    spread = m * (1 - m)
    surplus = F.sum((F.col("bad") - F.col("n") * m) ** 2 - F.col("n") * spread)
    room = F.sum(F.col("n") * (F.col("n") - 1) * spread)
    correlation = F.greatest(F.lit(CORRELATION[0]), F.least(F.lit(CORRELATION[1]), F.coalesce(surplus / F.nullif(room, F.lit(0.0)), F.lit(CORRELATION[1]))))
    return groups.agg(correlation.alias("correlation")).select((1 / F.col("correlation") - 1).alias("weight"))


def _shrunk(groups: DataFrame, expected: str, share: str) -> DataFrame:
    """``groups`` with the posterior mean around ``expected``."""
    weighed = beside_scalars(groups, _weight(groups, expected))
    return weighed.withColumn(share, (F.col("bad") + F.col("weight") * F.col(expected)) / (F.col("n") + F.col("weight")))


def reputations(hosts: DataFrame) -> DataFrame:
    """host, n, bad, bad_share, bound from ``hosts`` (host, n, bad): every host with its posterior and its lower bound."""
    domain, suffix = domain_and_suffix(F.col("host"))
    hosts = hosts.select("host", F.col("n").cast("double").alias("n"), F.col("bad").cast("double").alias("bad"), domain.alias("domain"), suffix.alias("suffix"))
    counts = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = hosts.groupBy("suffix", "domain").agg(*counts)
    suffixes = domains.groupBy("suffix").agg(*counts)
    # one outcome at PRIOR keeps the share of all within 0 and 1
    overall = suffixes.agg(((F.coalesce(F.sum("bad"), F.lit(0.0)) + PRIOR) / (F.coalesce(F.sum("n"), F.lit(0.0)) + 1)).alias("all_share"))
    suffixes = _shrunk(beside_scalars(suffixes, overall), "all_share", "suffix_share").select("suffix", "suffix_share")
    domains = _shrunk(domains.join(suffixes, "suffix"), "suffix_share", "domain_share").select("suffix", "domain", "domain_share")
    judged = _shrunk(hosts.join(domains, ["suffix", "domain"]), "domain_share", "bad_share")
    p, size = F.col("bad_share"), F.col("n") + F.col("weight")
    error = F.sqrt(1 / (p * (1 - p) * (size + 1)))
    bound = 1 / (1 + F.exp(F.lit(BOUND_Z) * error - F.log(p / (1 - p))))
    return judged.select("host", F.col("n").cast("long").alias("n"), F.col("bad").cast("long").alias("bad"), "bad_share", bound.alias("bound"))


def document_of(path: Column) -> Column:
    """The number of the document that a path ends with, else null."""
    number = F.regexp_extract(path, r"/([0-9]{1,18})(?:\.html)?/?\z", 1)
    return F.when(number != "", number).cast("long")


def host_outcomes(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """host, n, bad of every host of ``pages`` (host, document), by ``outcomes`` (document, bad 0 or 1)."""
    seen = pages.groupBy("host", "document").agg(F.count("*").alias("pages"))
    known = outcomes.filter("document is not null and bad is not null").groupBy("document").agg(F.count("*").alias("labels"), F.sum("bad").alias("bad"))
    met = seen.join(known, "document", "left")
    return met.groupBy("host").agg(
        F.coalesce(F.sum(F.col("pages") * F.col("labels")), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.col("pages") * F.col("bad")), F.lit(0)).alias("bad"),
    )


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule], threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_share, bound of every page."""
    host, path = host_and_path(F.col("url"))
    read = pages.select("page_id", host.alias("host"), path.alias("path"))
    found = reputations(host_outcomes(read.select("host", document_of(F.col("path")).alias("document")), outcomes))
    ruled = read.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    by_host = F.when(F.col("bound") > threshold, "block").otherwise("allow")
    return ruled.join(found.select("host", "bad_share", "bound"), "host", "left").select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", by_host).alias("verdict"), "bad_share", "bound"
    )
