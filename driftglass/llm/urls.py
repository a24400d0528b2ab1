"""Rules and empirical-Bayes host reputation for urls, in DataFrame functions alone.

Labelled page outcomes (bad or not) are counted per host. Rates are shrunk level by level: the
public suffixes towards the overall rate, registered domains towards their suffix, hosts towards
their domain, each through a beta prior whose strength is estimated from the counts by moments.
A host is blocked when the lower bound of its posterior bad rate is above a limit, which is to say that the beta posterior
has at least the wanted confidence above the limit; that share is integrated numerically, in column expressions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage

#: (verdict, host, path), the longest that fits wins.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: Suffixes of more than one label, for want of a whole list of public suffixes, which may be given instead; any other suffix is the last label.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "com.br", "co.in", "co.za", "com.cn", "com.mx", "com.tr")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _until(text: Column, stops: str) -> Column:
    """The part of text before the first of the characters in stops. All stops become the first of them, then one split."""
    same = F.translate(text, stops, stops[0] * len(stops))
    return F.substring_index(same, stops[0], 1)


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first '://', up to '/', '?' or '#' with A-Z lower-cased; then up to '?' or '#'.

    A null url, or one without '://', has an empty host and path.
    """
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = _until(rest, "/?#")
    path = _until(F.substr(rest, F.length(host) + 1), "?#")
    return F.translate(host, _UPPER, _LOWER), path


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, nulls if none does.

    A rule fits its host and all subdomains if the path starts with its path. Length is that of host
    and path together; of equally long ones the longer host, then the smaller text, wins.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1] + r[2]))
    rule = verdict = None
    for said, on, start in ordered:
        fits = ((host == on) | F.endswith(host, F.lit("." + on))) & F.startswith(path, F.lit(start))
        rule = F.when(fits, F.lit(on + start)) if rule is None else rule.when(fits, F.lit(on + start))
        verdict = F.when(fits, F.lit(said)) if verdict is None else verdict.when(fits, F.lit(said))
    if rule is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return rule, verdict


def levels(host: Column, long_suffixes: Sequence[str] = LONG_SUFFIXES) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host; user names and ports are left aside, '' belongs to ''.

    An address (digits and dots alone, or in brackets) is its own domain, and all addresses share the suffix ''.
    """
    named = F.substring_index(host, "@", -1)
    address = named.rlike(r"^([0-9.]+|\[[^\]]*\])(:[0-9]*)?$") & (named != "")
    bare = F.when(address, F.regexp_replace(named, r"([0-9\]]):[0-9]*$", "$1")).otherwise(F.substring_index(named, ":", 1))
    two, three = F.substring_index(bare, ".", -2), F.substring_index(bare, ".", -3)
    long = two.isin(*long_suffixes)
    domain = F.when(address, bare).when(long, three).otherwise(two)
    return domain, F.when(address, F.lit("")).when(long, two).otherwise(F.substring_index(bare, ".", -1))


#: (distance, logarithm of the weight) of the points at which a function is summed from a place on to infinity: steps of a double-exponential rule.
STEP = 0.125
POINTS = tuple((math.exp(s - math.exp(-s)), math.log(STEP * (1 + math.exp(-s))) + s - math.exp(-s)) for s in (STEP * k for k in range(-24, 57)))


def beta_above(a: Column, b: Column, limit: float) -> Column:
    """The share of a beta distribution that lies above `limit` (between 0 and 1).

    In t = ln(x / (1 - x)) the density is x**a (1 - x)**b; it is summed to either side of the limit, relative to its top.
    """
    start = math.log(limit / (1 - limit))
    top = a * F.log(a / (a + b)) + b * F.log(b / (a + b))
    points = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(w).alias("w")) for d, w in POINTS])

    def side(sign: float) -> Column:
        def at(total: Column, point: Column) -> Column:
            t = F.lit(start) + F.lit(sign) * point["d"]
            return total + F.exp(-a * F.log1p(F.exp(-t)) - b * F.log1p(F.exp(t)) - top + point["w"])

        return F.aggregate(points, F.lit(0.0), at)

    above, below = side(1.0), side(-1.0)
    return above / (above + below)


def _strength(table: DataFrame, mean: Column | str) -> DataFrame:
    """One row: the beta prior's strength by moments (pairs of draws from one group agreeing more than by chance).

    With n outcomes, k of them bad and the parent's rate m: sum (k(k-1) - 2m(n-1)k + m^2 n(n-1)) estimates
    rho * sum m(1-m) n(n-1). The strength 1/rho - 1 is kept within 1 and 1000; too few outcomes give 1000.
    """
    n, k, m = F.col("n").cast("double"), F.col("bad").cast("double"), F.col(mean) if isinstance(mean, str) else mean
    excess = F.sum(k * (k - 1) - 2 * m * (n - 1) * k + m * m * n * (n - 1))
    scale = F.sum(m * (1 - m) * n * (n - 1))
    rho = F.when(scale > 0, excess / F.when(scale > 0, scale))
    clipped = F.least(F.greatest(F.coalesce(rho, F.lit(0.0)), F.lit(1 / 1001)), F.lit(0.5))
    return table.agg((1 / clipped - 1).alias("strength"))


def reputations(outcomes: DataFrame, limit: float = 0.5, long_suffixes: Sequence[str] = LONG_SUFFIXES) -> DataFrame:
    """(host, n, bad, rate, above) of each host in outcomes(host, bad 0 or 1): posterior mean, and share of the posterior above limit.

    Rows with a null are not outcomes; without outcomes there are no hosts. Only counts move: hosts are summed first and written, domains come from
    hosts, suffixes from domains.
    """
    hosts = (outcomes.filter("host is not null and bad is not null").groupBy("host")
             .agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad")))
    domain, suffix = levels(F.col("host"), long_suffixes)
    hosts = stage(hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "bad"), "hosts")
    domains = stage(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    overall = domains.agg(((F.sum("bad") + 0.5) / (F.sum("n") + 1.0)).alias("parent"))

    def shrink(table: DataFrame) -> DataFrame:
        """Posterior mean of each row of table(…, n, bad, parent)."""
        known = table.crossJoin(F.broadcast(_strength(table, "parent")))  # one row
        return known.withColumn("rate", (F.col("bad") + F.col("strength") * F.col("parent")) / (F.col("n") + F.col("strength")))

    top = shrink(suffixes.crossJoin(F.broadcast(overall)))  # one row
    middle = stage(shrink(domains.join(top.select("suffix", F.col("rate").alias("parent")), "suffix")).select("domain", F.col("rate").alias("parent")), "domain-rates")
    low = stage(shrink(hosts.join(middle, "domain")), "host-rates")
    unstage(hosts, domains, middle)
    a = F.col("bad") + F.col("strength") * F.col("parent")
    b = F.col("n") - F.col("bad") + F.col("strength") * (1 - F.col("parent"))
    return low.select("host", "n", "bad", "rate", beta_above(a, b, limit).alias("above"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, limit: float = 0.5, confidence: float = 0.95,
               long_suffixes: Sequence[str] = LONG_SUFFIXES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page, repeated rows as often as they come.

    The longest rule that fits decides. Without one, a host whose bad rate is above `limit` with a posterior
    probability of `confidence` at least is blocked, every other one (hosts without outcomes, null urls) allowed.
    Null page ids are passed on, an empty table gives no rows, other columns are not read.
    The join with the hosts' table is a plain one, so a host with a third of all pages is split.
    """
    host, path = split_url(F.col(url))
    seen = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, ruled = match_rule(F.col("host"), F.col("path"), rules)
    bad_hosts = reputations(outcomes, limit, long_suffixes).filter(F.col("above") >= confidence).select("host", F.lit("block").alias("judged"))
    return seen.join(bad_hosts, "host", "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(ruled, F.col("judged"), F.lit("allow")).alias("verdict"))


def labelled_pages(pages: DataFrame, labels: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Outcomes (host, bad) of pages whose document is labelled.

    A page shows the document that the first number of its path names. It is bad if labelled toxic or of
    low quality. Of several labels of a document the worst counts; a label that is null counts as good.
    """
    host, path = split_url(F.col(url))
    number = F.regexp_extract(path, r"/(\d{1,18})(?:\D|$)", 1)
    shown = pages.select(host.alias("host"), F.when(number != "", number.cast("long")).alias("__doc")).filter("__doc is not null")
    told = (labels.select(F.col("doc_id").alias("__doc"), (F.coalesce(F.col("toxic"), F.lit(0)) == 1).alias("t"), (F.coalesce(F.col("quality"), F.lit(1)) == 0).alias("q"))
            .groupBy("__doc").agg(F.max((F.col("t") | F.col("q")).cast("int")).alias("bad")))
    return shown.join(told, "__doc").select("host", "bad")
