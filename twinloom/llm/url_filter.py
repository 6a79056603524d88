"""URL filters: longest matching rule, else empirical-Bayes reputation of the host.

Labelled page outcomes are counted by host, registered domain and public suffix. Each level is a
beta-binomial whose prior mean is the posterior mean of the level above and whose prior weight is
fitted to the spread between its members. A page without a rule is blocked if the lower bound of
its host's bad rate is above a limit. DataFrame functions throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinloom.storage import cut_lineage

# Deviations below the mean of the posterior, and the bad rate that the bound may not exceed.
BOUND = 1.645
MAX_BAD_RATE = 0.5
# Prior weights stay inside these; a level without spread gets the largest.
WEIGHTS = (1.0, 1000.0)
# Public suffixes of two labels under which names of these countries are commonly registered.
# Others, private ones (hosting services) and longer ones are not listed: there the last label is the suffix.
SUFFIXES = tuple("""
    ac.uk co.uk gov.uk ltd.uk me.uk net.uk nhs.uk org.uk plc.uk police.uk sch.uk
    asn.au com.au edu.au gov.au id.au net.au org.au
    ac.nz co.nz geek.nz gen.nz govt.nz iwi.nz kiwi.nz maori.nz mil.nz net.nz org.nz school.nz
    ac.jp ad.jp co.jp ed.jp go.jp gr.jp lg.jp ne.jp or.jp
    ac.kr co.kr go.kr ne.kr or.kr pe.kr re.kr
    ac.cn com.cn edu.cn gov.cn mil.cn net.cn org.cn
    com.tw edu.tw gov.tw idv.tw net.tw org.tw
    com.hk edu.hk gov.hk idv.hk net.hk org.hk
    com.sg edu.sg gov.sg net.sg org.sg
    com.my edu.my gov.my net.my org.my
    ac.th co.th go.th in.th net.th or.th
    ac.id co.id go.id net.id or.id sch.id web.id
    com.ph edu.ph gov.ph net.ph org.ph
    com.vn edu.vn gov.vn net.vn org.vn
    ac.in co.in edu.in firm.in gen.in gov.in ind.in net.in nic.in org.in res.in
    com.pk edu.pk gov.pk net.pk org.pk
    ac.il co.il gov.il muni.il net.il org.il
    com.tr edu.tr gen.tr gov.tr net.tr org.tr
    com.sa edu.sa gov.sa org.sa
    ac.ae co.ae gov.ae net.ae org.ae
    ac.za co.za gov.za net.za org.za web.za
    ac.ke co.ke go.ke or.ke
    com.ng edu.ng gov.ng org.ng
    adv.br art.br blog.br com.br eco.br edu.br gov.br jus.br net.br org.br
    com.ar edu.ar gob.ar net.ar org.ar
    com.mx edu.mx gob.mx net.mx org.mx
    com.co edu.co gov.co net.co org.co
    com.pe edu.pe gob.pe org.pe
    com.ve co.ve gob.ve org.ve
    com.ua edu.ua gov.ua net.ua org.ua
    com.pl edu.pl gov.pl net.pl org.pl
    ac.at co.at or.at
    com.es org.es com.pt com.gr co.hu
""".split())
_ADDRESS = r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$|^\["
_PORT = r":[0-9]*$"
# (rule, verdict)
Rules = tuple[tuple[str, str], ...]


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the host's end up to ``?`` or ``#``."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def without_port(host: Column) -> Column:
    """The host as the levels above it see it; the host itself keeps its port."""
    return F.regexp_replace(host, _PORT, "")


def _labels_of(host: Column) -> Column:
    return F.split(host, r"\.")


def _suffix_labels(host: Column, suffixes: tuple[str, ...]) -> Column:
    """How many labels the public suffix has."""
    return F.when(F.array_join(F.slice(_labels_of(host), -2, 2), ".").isin(*suffixes), 2).otherwise(1)


def _last(host: Column, labels: Column) -> Column:
    """The last labels; the host if it has no more, or is an address."""
    parts = _labels_of(host)
    whole = (F.size(parts) <= labels) | host.rlike(_ADDRESS)
    return F.when(whole, host).otherwise(F.array_join(F.slice(parts, -labels, labels), "."))


def suffix_of(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The public suffix: a listed one of two labels, or the last label. A port does not count."""
    bare = without_port(host)
    return _last(bare, _suffix_labels(bare, suffixes))


def registered_domain(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The public suffix and the label before it, or the host if it has no more. A port does not count."""
    bare = without_port(host)
    return _last(bare, _suffix_labels(bare, suffixes) + 1)


def longest_rule(host: Column, path: Column, rules: Rules) -> tuple[Column, Column]:
    """``(rule, verdict)`` of the longest rule that fits, nulls without one.

    Rules are few and given by hand: a chain of conditions, longest first. At equal length a rule
    that blocks goes first, then the smaller text.
    """
    order = sorted(rules, key=lambda r: (-len(r[0]), r[1] != "block", r[0]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, decision in reversed(order):
        name, _, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    return rule, verdict


def _prior_weight(groups: DataFrame, mean: Column) -> float:
    """Method of moments: the weight at which a beta prior has the spread seen between groups."""
    m, n = mean, F.col("n")
    # E[(bad - n m)^2] = n m (1 - m) (1 + (n - 1) / (w + 1))
    row = groups.where("n > 1").agg(
        F.sum((F.col("bad") - n * m) ** 2 - n * m * (1 - m)).alias("over"),
        F.sum(n * (n - 1) * m * (1 - m)).alias("most"),
    ).first()
    low, high = WEIGHTS
    if not row["over"] or not row["most"] or row["over"] <= 0:
        return high
    return min(max(row["most"] / row["over"] - 1, low), high)


def _shrunk(groups: DataFrame, mean: Column, name: str) -> DataFrame:
    """Posterior ``a, b`` of each group and its mean under ``name``."""
    weight = _prior_weight(groups, mean)
    a, b = mean * weight + F.col("bad"), (1 - mean) * weight + F.col("n") - F.col("bad")
    return groups.withColumns({"a": a, "b": b, name: a / (a + b)})


def host_reputation(outcomes: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """``(host, a, b)`` from ``(host, bad)`` rows, ``bad`` being 1, 0 or null where unlabelled.

    Sums are combined before each shuffle. The levels above are joined to the one below, so no
    suffix or domain is gathered in one place. A host without outcomes has its domain's prior.
    """
    sums = [F.sum("bad").alias("bad"), F.sum("n").alias("n")]
    known = outcomes.groupBy("host").agg(
        F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.count("bad").alias("n")
    )
    levels = {"domain": registered_domain(F.col("host"), suffixes), "suffix": suffix_of(F.col("host"), suffixes)}
    hosts = cut_lineage(known.withColumns(levels))
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    above = domains.groupBy("suffix").agg(*sums)
    total = hosts.agg(*sums).first()
    overall = (total["bad"] + 0.5) / (total["n"] + 1) if total["n"] else 0.5
    above = _shrunk(above, F.lit(overall), "suffix_mean").select("suffix", "suffix_mean")
    domains = _shrunk(domains.join(above, "suffix"), F.col("suffix_mean"), "domain_mean")
    domains = cut_lineage(domains.select("domain", "domain_mean"))
    return _shrunk(hosts.join(domains, "domain"), F.col("domain_mean"), "mean").select("host", "a", "b")


def judge_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules: Rules,
    bound: float = BOUND,
    limit: float = MAX_BAD_RATE,
    suffixes: tuple[str, ...] = SUFFIXES,
) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, bad_rate_bound``.

    ``suffixes`` are the public suffixes of two labels, a list of bounded size.
    A label belongs to the page of its ``doc_id``; low quality or toxic counts as bad. A url that
    is missing or has no ``://`` has empty host and path and the reputation of the empty host.
    Repeated pages are judged alike; an empty table gives no rows; other columns are not read.
    """
    url = F.coalesce(F.col("url"), F.lit(""))
    split = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    bad = F.when((F.col("quality") <= 0) | (F.col("toxic") > 0), 1).when(
        F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0
    )
    known = labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    reputation = host_reputation(split.join(known, "page_id", "left").select("host", "bad"), suffixes)
    a, b = F.col("a"), F.col("b")
    lower = a / (a + b) - bound * F.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    found = F.when(F.col("bad_rate_bound") > limit, "block").otherwise("allow")
    judged = split.join(reputation.select("host", F.round(lower, 6).alias("bad_rate_bound")), "host")
    return judged.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, found).alias("verdict"), "bad_rate_bound"
    )
