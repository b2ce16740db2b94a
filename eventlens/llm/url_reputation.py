"""URL filter: explicit rules, and empirical-Bayes host reputation where none fits.

Pages with known outcomes (bad or not) are counted by host. A host's rate of bad pages
is shrunk to that of its registered domain, which is shrunk to that of its suffix, which
is shrunk to the overall rate, each through a beta-binomial prior whose strength is
estimated from how much the children of that level differ. A page is blocked if the
lower posterior bound of its host's rate exceeds a limit that follows from the overall
rate: the odds of a bad page must be credibly ``EXCESS`` times those of the whole corpus.
So little evidence blocks nothing, and where hosts don't differ no host is blocked.
Everything is DataFrame expressions; only the four fitted numbers of the priors reach
the driver.

A host is judged without its port. Its suffix is the longest of ``SUFFIXES`` that it ends
with, else its last label; its registered domain is the suffix and one more label. An
address in numbers is its own domain, below a common suffix of such addresses.

Defined cases: a null url, or one without ``://``, has an empty host and path, and is
judged as host ''. Outcomes of pages that aren't there, and null outcomes, are ignored;
without any outcome no host is blocked. Repeated rows count as often as they occur.
Extra columns are ignored; an empty table yields no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.llm._shared import Scratch

#: (verdict, host, path): the longest rule that fits decides.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Public suffixes of two labels or three under which names are registered; others are the last label. A parameter.
SUFFIXES = (
    "ac.at", "co.at", "or.at", "asn.au", "com.au", "edu.au", "gov.au", "id.au", "net.au", "org.au", "com.ar", "com.br", "gov.br",
    "net.br", "org.br", "ac.cn", "com.cn", "edu.cn", "gov.cn", "net.cn", "org.cn", "com.co", "co.cr", "com.eg", "com.hk", "edu.hk",
    "co.id", "ac.il", "co.il", "ac.in", "co.in", "gov.in", "net.in", "org.in", "ac.jp", "co.jp", "go.jp", "ne.jp", "or.jp", "ac.kr",
    "co.kr", "go.kr", "or.kr", "com.mx", "com.my", "com.ng", "ac.nz", "co.nz", "govt.nz", "net.nz", "org.nz", "com.pe", "com.ph",
    "com.pk", "com.pl", "com.sg", "edu.sg", "co.th", "in.th", "com.tr", "com.tw", "edu.tw", "org.tw", "com.ua", "ac.uk", "co.uk",
    "gov.uk", "ltd.uk", "me.uk", "net.uk", "nhs.uk", "org.uk", "plc.uk", "sch.uk", "com.uy", "co.ve", "com.vn", "ac.za", "co.za",
    "org.za", "appspot.com", "blogspot.com", "github.io", "gitlab.io", "herokuapp.com", "netlify.app", "pages.dev", "vercel.app",
    "web.app", "wordpress.com", "s3.amazonaws.com",
)
#: A host is blocked if its odds of a bad page exceed EXCESS times those of all pages, with Z standard deviations to spare.
EXCESS, Z = 2.0, 1.645
#: Bounds of the correlation within a level, from which a prior's strength follows.
CORRELATION = (0.001, 0.5)

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: str = "url") -> Column:
    """What follows the first ``://`` up to a slash, question mark, hash or the end."""
    found = F.coalesce(F.regexp_extract(F.col(url), _URL, 1), F.lit(""))
    return F.translate(found, _UPPER, _UPPER.lower())


def path_of(url: str = "url") -> Column:
    """What follows the host up to a question mark, hash or the end."""
    return F.coalesce(F.regexp_extract(F.col(url), _URL, 2), F.lit(""))


def name_of(host: Column) -> Column:
    """A host without user, port and closing dot: what reputation is counted by."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"\.?(:[0-9]*)?$", "")


def _numeric(name: Column) -> Column:
    return name.rlike(r"^([0-9]{1,3}(\.[0-9]{1,3}){3}|\[.*\])$")


def suffix_of(name: Column, suffixes=SUFFIXES) -> Column:
    """The longest of ``suffixes`` that a name ends with, else its last label."""
    found = F.substring_index(name, ".", -1)
    for labels in (2, 3):
        own = [x for x in suffixes if x.count(".") == labels - 1]
        end = F.substring_index(name, ".", -labels)
        found = F.when(end.isin(own), end).otherwise(found) if own else found
    return F.when(_numeric(name), F.lit("(address)")).otherwise(found)


def domain_of(name: Column, suffixes=SUFFIXES) -> Column:
    """The registered domain: the suffix and one label before it, or what there is."""
    many = F.size(F.split(suffix_of(name, suffixes), r"\."))
    found = F.substring_index(name, ".", -2)
    for labels in (2, 3):
        found = F.when(many == labels, F.substring_index(name, ".", -labels - 1)).otherwise(found)
    return F.when(_numeric(name), name).otherwise(found)


def matched(rules, what: int) -> Column:
    """The longest fitting rule's text (what=0) or verdict (what=1) for ``host, path``; null if none fits."""
    if len(rules) > 1000:
        raise ValueError("at most 1000 rules; they become one expression")
    found = F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        under = (F.col("host") == host) | F.col("host").endswith("." + host)
        found = F.when(under & F.col("path").startswith(path), (host + path, verdict)[what]).otherwise(found)
    return found


def _strength(children: DataFrame, mean: str) -> float:
    """Prior strength of a level by moments: ``children`` have n, bad and their parent's mean.

    With a correlation rho within a child, n(p-m)^2/(m(1-m)) has expectation 1+(n-1)rho.
    """
    m, n = F.col(mean), F.col("n")
    excess = n * F.pow(F.col("bad") / n - m, 2) / (m * (1 - m)) - 1
    over, pairs = children.where("n > 0").agg(F.sum(excess), F.sum(n - 1)).first()
    rho = (over or 0.0) / pairs if pairs else CORRELATION[0]
    rho = min(max(rho, CORRELATION[0]), CORRELATION[1])
    return 1 / rho - 1


def reputation(outcomes: DataFrame, suffixes=SUFFIXES) -> tuple[DataFrame, float]:
    """Posterior of each host in ``outcomes`` (``host, bad`` with bad 0 or 1, or null).

    Returns ``host, domain, suffix, alpha, beta`` and the overall rate. Counts are added
    up by host, then hosts by domain and domains by suffix; no level sees single pages
    but the first, whose rows are added up before they are shuffled.
    """
    cut = Scratch(outcomes.sparkSession, "reputation").cut
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = cut(hosts.withColumn("domain", domain_of(F.col("host"), suffixes)).withColumn("suffix", suffix_of(F.col("host"), suffixes)))
    total = lambda df, *keys: df.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = cut(total(hosts, "domain", "suffix"))
    tops = cut(total(domains, "suffix"))
    n, bad = tops.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    rate = (bad + 1) / (n + 2)
    k = _strength(tops.withColumn("rate", F.lit(rate)), "rate")
    # A parent's rate is that of its other children: a page isn't evidence twice.
    rest = lambda mean: (F.col("all_bad") - F.col("bad") + k * mean) / (F.col("all_n") - F.col("n") + k)  # noqa: E731, B023
    above = lambda df, key, *more: df.select(key, F.col("n").alias("all_n"), F.col("bad").alias("all_bad"), *more)
    domains = domains.join(above(tops, "suffix"), "suffix").withColumn("suffix_rate", rest(F.lit(rate)))
    k = _strength(domains, "suffix_rate")
    hosts = hosts.join(above(domains, "domain", "suffix_rate"), "domain").withColumn("domain_rate", rest(F.col("suffix_rate")))
    k = _strength(hosts, "domain_rate")
    alpha = F.col("bad") + k * F.col("domain_rate")
    beta = F.col("n") - F.col("bad") + k * (1 - F.col("domain_rate"))
    return hosts.select("host", "domain", "suffix", alpha.alias("alpha"), beta.alias("beta")), rate


def lower_bound(alpha: Column, beta: Column, z: float = Z) -> Column:
    """Mean of a beta distribution less z standard deviations."""
    total = alpha + beta
    return alpha / total - z * F.sqrt(alpha * beta / (total * total * (total + 1)))


def limit_of(rate: float, excess: float = EXCESS) -> float:
    """The rate whose odds are ``excess`` times those of ``rate``."""
    odds = excess * rate / (1 - rate)
    return odds / (1 + odds)


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, excess: float = EXCESS, z: float = Z, suffixes=SUFFIXES) -> DataFrame:
    """``page_id, host, path, rule, verdict, bad_bound`` of each page.

    ``outcomes`` has ``url`` and ``bad``. ``bad_bound`` is the lower bound of the host's
    rate of bad pages, to six digits. Hosts of pages are among those of ``outcomes`` or are
    judged by no evidence, which allows them; their bound is null.
    """
    known, rate = reputation(outcomes.select(name_of(host_of()).alias("host"), F.col("bad")), suffixes)
    bound = lower_bound(F.col("alpha"), F.col("beta"), z)
    known = known.select(F.col("host").alias("name"), F.round(bound, 6).alias("bad_bound"), (bound > limit_of(rate, excess)).alias("bad_host"))
    split = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of().alias("host"), path_of().alias("path"))
    split = split.withColumn("rule", matched(rules, 0)).withColumn("verdict", matched(rules, 1)).withColumn("of", name_of(F.col("host")))
    joined = split.join(known, F.col("of") == F.col("name"), "left")
    own = F.when(F.col("bad_host"), "block").otherwise("allow")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), "bad_bound")
