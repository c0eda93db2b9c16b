"""URL filter: allow/block rules, and an empirical-Bayes reputation of hosts for the rest.

Labelled page outcomes (0 good, 1 bad) are counted per host.  A beta-binomial prior runs down
from all pages to public suffix, registered domain and host; at each level its strength comes
from the spread between the groups of that level (an ANOVA estimate of the intra-class
correlation).  A host is blocked where the lower bound of its posterior bad share exceeds a
threshold.  Hosts without labels inherit their domain's or suffix's prior.

Public suffixes follow rules: a table with wildcards (``*.ck``: every name below) and exceptions
(``!www.ck``), usual second-level names below countries' domains of two letters, and the states
of ``us`` with their schools, colleges and libraries.  Exceptions win, then the rule of most labels; with
none the last label is the suffix.  The registered domain has one label more.  Further rules are a
parameter, in the same form; the table holds the common ones, not every rule there is.

Posteriors of hosts are sent to all tasks while hosts are few (counted), else joined with salted
hosts, so a host that holds a third of all pages is no single task.

Null urls and urls without ``://`` have an empty host and path; they fit no rule and get the
verdict of an unlabelled host without domain.  Urls of any length are judged whole.  Of equally
long rules the later in text order wins.  Repeated rows give repeated results, each label of a
repeated id counts.  Empty tables give an empty result; without labels every host has the
prior.  Columns other than the id, the url and the outcome are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .common import ascii_lower, named, written

# Usual second-level names below countries' domains.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "gv", "ltd", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
# Public suffixes.
PUBLIC_SUFFIXES = (
    "ac.uk co.uk gov.uk ltd.uk me.uk net.uk nhs.uk org.uk plc.uk police.uk *.sch.uk "
    "asn.au com.au edu.au gov.au id.au net.au org.au "
    "ab.ca bc.ca gc.ca mb.ca nb.ca nl.ca ns.ca on.ca qc.ca sk.ca yk.ca "
    "asso.fr com.fr gouv.fr nom.fr prd.fr tm.fr "
    "ac.nz co.nz geek.nz gen.nz govt.nz iwi.nz kiwi.nz maori.nz net.nz org.nz school.nz "
    "ac.in co.in firm.in gen.in gov.in ind.in net.in nic.in org.in res.in "
    "ad.jp gr.jp lg.jp "
    "*.kawasaki.jp !city.kawasaki.jp *.kitakyushu.jp !city.kitakyushu.jp *.kobe.jp !city.kobe.jp *.nagoya.jp !city.nagoya.jp "
    "*.sapporo.jp !city.sapporo.jp *.sendai.jp !city.sendai.jp *.yokohama.jp !city.yokohama.jp "
    "aichi.jp chiba.jp fukuoka.jp hiroshima.jp hokkaido.jp hyogo.jp kanagawa.jp kyoto.jp nagano.jp okinawa.jp osaka.jp saitama.jp shizuoka.jp tokyo.jp "
    "adv.br art.br blog.br eng.br ind.br inf.br jus.br leg.br med.br *.nom.br "
    "*.bd *.ck !www.ck *.er *.fk *.jm *.kh *.mm *.np *.pg "
    "k12.il muni.il bel.tr k12.tr pol.tr kiev.ua lviv.ua odessa.ua "
    "br.com cn.com co.com com.de de.com eu.com gb.net jpn.com ru.com sa.com se.net uk.com uk.net us.com za.com "
    "appspot.com azurewebsites.net blogspot.com cloudfront.net ddns.net duckdns.org dyndns.org firebaseapp.com fly.dev github.io githubusercontent.com gitlab.io glitch.me "
    "herokuapp.com myshopify.com neocities.org netlify.app no-ip.org onrender.com pages.dev readthedocs.io surge.sh vercel.app web.app webflow.io weebly.com wixsite.com workers.dev "
    "s3.amazonaws.com *.compute.amazonaws.com *.elb.amazonaws.com "
).split()
# Suffixes below states of ``us``.
STATE_LEVEL = ("cc", "k12", "lib")
#: So many hosts are sent to all tasks; beyond, pages and hosts meet under ``SALTS`` keys a host.
BROADCAST_HOSTS = 1_000_000
SALTS = 16
#: Above so many rules a join replaces the literal table.
LITERAL_RULES = 500


@dataclass(frozen=True)
class Rule:
    """``target`` is host/path; it fits the host and all subdomains, below the path."""

    verdict: str
    target: str


# The rules of the registered query.
RULES = (
    Rule("allow", "com/"),
    Rule("block", "example.com/en/"),
    Rule("allow", "www.example.com/en/"),
    Rule("block", "net/es/"),
    Rule("block", "net/fr/"),
)


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return ascii_lower(rest)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def with_domain(hosts: DataFrame, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``domain`` and ``suffix`` to a table with ``host``; ports and user names don't count.

    ``suffixes`` are further rules.
    """
    rules = (*PUBLIC_SUFFIXES, *suffixes)
    exact, below, but = [r for r in rules if r[0] not in "*!"], [r[2:] for r in rules if r[0] == "*"], [r[1:] for r in rules if r[0] == "!"]
    most = max(r.count(".") for r in rules) + 1
    bare = F.regexp_replace(F.regexp_replace("host", r"^.*@", ""), r"(:[0-9]*|\.)$", "")
    parts = hosts.select("*", bare.alias("_bare"), F.split(bare, r"\.").alias("_labels"))
    last = lambda k: F.array_join(F.slice("_labels", F.greatest(F.size("_labels") - k + 1, F.lit(1)), k), ".")
    usual = rf"^(?:{'|'.join(SECOND_LEVEL)})\.[a-z]{{2}}$|^(?:(?:{'|'.join(STATE_LEVEL)})\.)?[a-z]{{2}}\.us$"
    length, except_ = F.lit(1), F.lit(None).cast("int")
    for k in range(1, most + 1):
        name, enough = F.col(f"_{k}"), F.size("_labels") >= k
        rule = name.isin(exact) | name.rlike(usual) | (F.col(f"_{k - 1}").isin(below) if k > 1 else F.lit(False))
        length = F.when(enough & rule, k).otherwise(length)
        except_ = F.coalesce(except_, F.when(enough & name.isin(but), k - 1))
    parts = parts.select("*", bare.rlike(r"^[0-9.]+$|^\[").alias("_number"), *[last(k).alias(f"_{k}") for k in range(1, most + 1)])
    parts = parts.select("*", F.coalesce(except_, length).alias("_n"))
    return parts.select(
        *hosts.columns,
        F.when(F.col("_number"), F.col("_bare")).otherwise(last(F.col("_n") + 1)).alias("domain"),
        F.when(F.col("_number"), F.lit("")).otherwise(last(F.col("_n"))).alias("suffix"),
    )


def strength(groups: DataFrame) -> tuple[float, float]:
    """(pooled bad share, prior strength) of a table with ``n`` and ``bad`` per group; one row comes back."""
    p = F.sum("bad") / F.sum("n")
    total = groups.agg(F.count("*").alias("g"), F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("q"), p.alias("p")).first() or Row(g=0)
    return _strength(total["g"], total["n"], total["bad"], total["nn"], total["q"])


def _strength(g, n, bad, nn, q) -> tuple[float, float]:
    if not g or not n:
        return 0.5, 2.0
    p = bad / n
    within = p * (1 - p)
    spread = q - n * p * p  # the sum of n_i (p_i - p)^2
    freedom = n - nn / n - (g - 1)
    if g < 2 or within <= 0 or freedom <= 0:
        return p, 2.0
    rho = min(max((spread - within * (g - 1)) / (within * freedom), 0.001), 0.999)
    return p, 1 / rho - 1


def reputations(hosts: DataFrame, outcomes: DataFrame, z: float = 1.645, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """Posterior of each ``host``: ``n``, ``bad``, ``mean``, ``lower`` and ``upper`` bound of its bad share.

    ``outcomes`` has ``host`` and ``bad`` (0 or 1), a row per labelled page.  Counts are
    combined before they are shuffled, so a host with most of the pages costs no more.
    """
    known = outcomes.where("host is not null and bad is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    known = written(with_domain(known, suffixes), "host-counts")
    by_domain = known.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    by_suffix = known.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    p, k_suffix = strength(by_suffix)
    _, k_domain = strength(by_domain)
    _, k_host = strength(known)

    def shrunk(bad: str, n: str, prior: Column, k: float) -> Column:
        count = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        return (count(bad) + F.lit(k) * prior) / (count(n) + F.lit(k))

    all_hosts = with_domain(hosts.select("host").distinct(), suffixes)
    s = by_suffix.select("suffix", F.col("n").alias("n_s"), F.col("bad").alias("bad_s"))
    d = by_domain.select("domain", F.col("n").alias("n_d"), F.col("bad").alias("bad_d"))
    h = known.select("host", "n", "bad")
    out = all_hosts.join(s, "suffix", "left").join(d, "domain", "left").join(h, "host", "left")
    out = out.select("host", "domain", "suffix", "n", "bad", "n_d", "bad_d", shrunk("bad_s", "n_s", F.lit(p), k_suffix).alias("m_s"))
    out = out.select("host", "domain", "suffix", "n", "bad", shrunk("bad_d", "n_d", F.col("m_s"), k_domain).alias("m_d"))
    out = out.select("host", "domain", "suffix", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bad", F.lit(0)).alias("bad"), shrunk("bad", "n", F.col("m_d"), k_host).alias("mean"))
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + k_host + 1))
    return out.select("*", F.greatest(F.lit(0.0), F.col("mean") - z * sd).alias("lower"), F.least(F.lit(1.0), F.col("mean") + z * sd).alias("upper"))


def fits(host: Column, path: Column, rule_host: Column, rule_path: Column) -> Column:
    return ((host == rule_host) | F.endswith(host, F.concat(F.lit("."), rule_host))) & F.startswith(path, rule_path)


def with_rule(pages: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Adds ``rule`` (the longest that fits, by text where equally long) and ``rule_verdict`` to host and path."""
    table = [(r.target.partition("/")[0], "/" + r.target.partition("/")[2], r.target, r.verdict) for r in rules]
    best = lambda fit: F.struct(F.length(fit["target"]).alias("size"), fit["target"].alias("target"), fit["verdict"].alias("verdict"))
    if not table:
        return pages.select("*", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("rule_verdict"))
    if len(table) <= LITERAL_RULES:
        known = F.array(*[F.struct(*[F.lit(x).alias(k) for k, x in zip(("host", "path", "target", "verdict"), r)]) for r in table])
        hit = F.filter(known, lambda r: fits(F.col("host"), F.col("path"), r["host"], r["path"]))
        out = pages.select("*", F.array_max(F.transform(hit, best)).alias("_best"))
        return out.select(*pages.columns, F.col("_best.target").alias("rule"), F.col("_best.verdict").alias("rule_verdict"))
    known = pages.sparkSession.createDataFrame(table, "host string, path string, target string, verdict string")
    keys = written(pages.select("host", "path").distinct(), "url-keys")
    labels = keys.select("host", "path", F.split("host", r"\.").alias("l"))
    tails = labels.select("host", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size("l")), lambda i: F.array_join(F.slice("l", i, F.size("l")), "."))).alias("tail"))
    hit = tails.join(known.select(F.col("host").alias("tail"), F.col("path").alias("rule_path"), "target", "verdict"), "tail").where(F.startswith("path", "rule_path"))
    top = hit.groupBy("host", "path").agg(F.max(F.struct(F.length("target").alias("size"), "target", "verdict")).alias("_best"))
    out = pages.join(top, ["host", "path"], "left")
    return out.select(*pages.columns, F.col("_best.target").alias("rule"), F.col("_best.verdict").alias("rule_verdict"))


def judge(
    pages: DataFrame, outcomes: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5, z: float = 1.645, suffixes: tuple[str, ...] = (),
    id_col: str = "page_id", url_col: str = "url", label_col: str = "bad",
) -> DataFrame:
    """host, path, rule, verdict and the posterior of every page.

    ``outcomes`` has ``id_col`` and ``label_col`` (1 for a bad page, 0 for a good one); where it
    comes from is the caller's choice.
    """
    base = pages.select(named(id_col).alias("page_id"), host_of(named(url_col)).alias("host"), path_of(named(url_col)).alias("path"))
    labelled = base.join(outcomes.select(named(id_col).alias("page_id"), named(label_col).cast("long").alias("bad")), "page_id").select("host", "bad")
    known = written(reputations(base, labelled, z, suffixes).select("host", "n", "bad", "mean", "lower"), "host-posteriors")
    out = with_rule(base, rules)
    if known.count() <= BROADCAST_HOSTS:
        out = out.join(F.broadcast(known), "host", "left")
    else:
        salted = known.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
        out = out.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS))).join(salted, ["host", "salt"], "left")
    verdict = F.coalesce("rule_verdict", F.when(F.col("lower") > threshold, F.lit("block")).otherwise(F.lit("allow")))
    return out.select(F.col("page_id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "n", "bad", "mean", "lower")
