"""URL filter: host reputation by empirical Bayes, under a list of explicit rules.

Labelled page outcomes are counted for each host. Beta-binomial priors shrink them level by level: all pages to the
suffix (``com``), the suffix to the registered domain (``example.com``), the domain to the host. A level's prior
strength is fitted by moments to how much the groups of that level differ. A host is blocked if the lower bound of its
posterior rate of bad pages is above a threshold. The bound is the beta quantile by the normal approximation with
its first correction for skew; against the exact quantile it is off by 0.05 at most where a and b are 1 or more
(a test integrates the density).

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged by the
reputation of the empty host. A url of any length is taken whole. A page without a label counts for nothing; of several
labels of one page the worst counts. Rows count as pages: a page that stands many times counts once for a host, and
each of its rows gets its own verdict. A null page_id has no label. An IP address is its own domain, under the suffix
``ip``. Empty tables give an empty result. Further columns of the inputs are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, materialised, tidied


#: Second levels that registries of two-letter countries commonly keep, as a pattern of the whole suffix.
TWO_LABELS = r"(?:co|com|org|net|ac|gov|edu|mil)\.[a-z]{2}"
#: Two-label suffixes of the public list that the pattern leaves out, for the largest countries.
SUFFIXES = (
    "ad.jp", "ed.jp", "go.jp", "gr.jp", "lg.jp", "ne.jp", "or.jp", "go.kr", "ne.kr", "or.kr", "pe.kr", "re.kr", "ltd.uk", "me.uk", "nhs.uk", "plc.uk", "police.uk", "sch.uk", "asn.au", "id.au", "gen.nz", "geek.nz", "govt.nz", "iwi.nz", "kiwi.nz", "maori.nz", "school.nz",
    "adv.br", "art.br", "blog.br", "eco.br", "eng.br", "ind.br", "jus.br", "nom.br", "gen.in", "firm.in", "ind.in", "nic.in", "res.in", "gob.ar", "gob.es", "gob.mx", "nom.es", "gouv.fr", "asso.fr", "go.id", "or.id", "web.id", "go.th", "in.th", "or.th", "web.za", "law.za", "nom.za", "idv.tw", "game.tw", "k12.tr", "gen.tr", "web.tr",
)
IPV4 = r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"


class Rule(NamedTuple):
    """verdict for a host with all its subdomains, where the path starts with path."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


class Reputation(NamedTuple):
    """threshold: the highest rate of bad pages that a host's lower bound may have. z: standard deviations from the mean to the bound. suffixes: two-label suffixes under which domains are registered, beside those that TWO_LABELS describes."""

    threshold: float = 0.5
    z: float = 1.645
    least_strength: float = 2.0
    most_strength: float = 1000.0
    suffixes: tuple[str, ...] = SUFFIXES


def host_of(url: Column) -> Column:
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def bare_host(host: Column) -> Column:
    """Without user and port."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")


def domain_pattern(suffixes: Sequence[str]) -> str:
    """The registered domain at the end of a host, its suffix as the only group."""
    return rf"[^.]+\.({'|'.join([TWO_LABELS, *(x.replace('.', '[.]') for x in suffixes), '[^.]+'])})$"


def domain_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> tuple[Column, Column]:
    """The registered domain, one label in front of the suffix, and the suffix; the host itself twice if it has no dot. An IP address, brackets included, is its own domain."""
    pattern = domain_pattern(suffixes)
    literal = F.regexp_like(host, F.lit(IPV4)) | host.startswith("[")
    found = F.regexp_extract(host, pattern, 0)
    suffix = F.regexp_extract(host, pattern, 1)
    return F.when(literal | (found == ""), host).otherwise(found), F.when(literal, F.lit("ip")).when(found == "", host).otherwise(suffix)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, both null without one; of equally long rules block comes first."""
    fits = lambda r: ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
    ranked = sorted(rules, key=lambda r: (-len(r.text), r.verdict != "block", r.text))
    null = F.lit(None).cast("string")
    return tuple(F.coalesce(*[F.when(fits(r), F.lit(x)) for r, x in ((r, pick(r)) for r in ranked)], null) for pick in (lambda r: r.text, lambda r: r.verdict))


def _strength(counts: DataFrame, n: str, y: str, p: Reputation) -> float:
    """Prior strength of a level from its groups: (1 - rho) / rho, rho by the moments of the beta-binomial distribution. One row of sums comes to the driver."""
    s = counts.filter(F.col(n) > 0).agg(
        F.count("*").alias("k"), F.sum(n).alias("n"), F.sum(y).alias("y"), F.sum(F.col(n).cast("double") * F.col(n)).alias("nn"), F.sum(F.col(y).cast("double") * F.col(y) / F.col(n)).alias("yy")
    ).first()
    if not s["k"] or s["k"] < 2:
        return p.most_strength
    mean = s["y"] / s["n"]
    within = mean * (1 - mean)
    room = within * (s["n"] - s["nn"] / s["n"] - (s["k"] - 1))
    if room <= 0:
        return p.most_strength
    rho = (s["yy"] - s["n"] * mean * mean - within * (s["k"] - 1)) / room
    return min(max((1 - rho) / rho, p.least_strength), p.most_strength) if rho > 0 else p.most_strength


def lower_bound(mean: Column, weight: Column, z: float) -> Column:
    """About the quantile at -z standard deviations of the beta distribution with this mean and a + b = weight. The correction is (z * z - 1) / 6 of the skew, in standard deviations."""
    skew = 2 * (1 - 2 * mean) * F.sqrt(weight + 1) / ((weight + 2) * F.sqrt(mean * (1 - mean)))
    return mean - (z - (z * z - 1) / 6 * skew) * F.sqrt(mean * (1 - mean) / (weight + 1))


def host_reputation(outcomes: DataFrame, p: Reputation = Reputation()) -> DataFrame:
    """outcomes: host, labelled (pages), bad (pages), a row for each host. Adds domain, suffix, mean, low (the posterior bound) and blocked."""
    domain, suffix = domain_of(bare_host(F.col("host")), p.suffixes)
    hosts = materialised(outcomes.withColumns({"domain": domain, "suffix": suffix}), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("labelled").alias("dn"), F.sum("bad").alias("dy"))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dy").alias("sy"))
    total = suffixes.agg(F.sum("sn").alias("n"), F.sum("sy").alias("y")).first()
    mean = (total["y"] + 0.5) / (total["n"] + 1.0) if total["n"] else 0.5
    k_suffix, k_domain, k_host = (_strength(d, n, y, p) for d, n, y in ((suffixes, "sn", "sy"), (domains, "dn", "dy"), (hosts, "labelled", "bad")))
    suffixes = suffixes.withColumn("suffix_mean", (F.col("sy") + k_suffix * mean) / (F.col("sn") + k_suffix))
    domains = domains.join(suffixes, "suffix").withColumn("domain_mean", (F.col("dy") + k_domain * F.col("suffix_mean")) / (F.col("dn") + k_domain))
    weight = F.col("labelled") + k_host
    rated = hosts.join(domains.select("domain", "domain_mean"), "domain").withColumn("mean", (F.col("bad") + k_host * F.col("domain_mean")) / weight)
    return rated.withColumn("low", lower_bound(F.col("mean"), weight, p.z)).withColumn("blocked", F.col("low") > p.threshold)


@tidied
def filter_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[Rule] = (), p: Reputation = Reputation()) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), bad_rate and bad_rate_low of the host, a row for each row of pages.

    pages: page_id, url. labels: doc_id (a page_id), quality (0 is a bad page).
    Counts are summed before they are shuffled, so a host with a third of all pages is one row for each task. The host
    table is joined from a written table: Spark broadcasts it if it is small, and splits the hot host's rows if not.
    """
    seen = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    bad = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("page_id")).agg(F.max((F.col("quality") == 0).cast("long")).alias("bad"))
    known = seen.join(bad, "page_id").select("page_id", "host", "bad").distinct().groupBy("host").agg(F.count("*").alias("labelled"), F.sum("bad").alias("bad"))
    none = F.lit(0).cast("long")
    outcomes = seen.select("host").distinct().join(known, "host", "left").select("host", F.coalesce("labelled", none).alias("labelled"), F.coalesce("bad", none).alias("bad"))
    hosts = materialised(host_reputation(outcomes, p).select("host", F.col("mean").alias("bad_rate"), F.col("low").alias("bad_rate_low"), "blocked"), "reputation")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("blocked"), "block").otherwise("allow")
    return seen.join(hosts, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "bad_rate", "bad_rate_low")
