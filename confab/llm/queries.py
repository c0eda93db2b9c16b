"""The registered queries of this package: thin digests of the operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _quality_sql() -> str:
    words = (
        "the of and to in is that it for was with as on be at by this are from or an der die und den von zu das mit sich des auf ist im nicht ein eine de la le "
        "et les en un une du que est pour dans qui sur au par el los las del y se con por una para su al lo como"
    )
    stops = ", ".join(f"'{w}'" for s in words.split() for w in (s, s.capitalize()))
    broken = """mean_word_chars < 1.5 OR mean_word_chars > 25 OR symbols_per_word > 0.5 OR dup_line_ratio > 0.5 OR (n_words >= 200 AND stop_word_ratio < 0.002)
                    OR (n_words >= 50 AND bullet_line_ratio > 0.95) OR (n_words >= 50 AND ellipsis_line_ratio > 0.5)"""
    return rf"""
WITH b AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM b)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS r FROM (SELECT doc_id, i + unnest(range(0, 5)) AS p FROM twice) GROUP BY doc_id),
m AS (
  SELECT b.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r, 0) AS n_repeat_words, len(l) AS n_lines,
         len(list_filter(w, lambda x: x IN ({stops}))) AS n_stop,
         len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•]'))) AS n_bullet,
         len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_cut
  FROM b LEFT JOIN rep ON b.doc_id = rep.doc_id),
k AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
         coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word_chars, coalesce(n_symbols / nullif(n_words, 0), 0) AS symbols_per_word,
         coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_ratio, coalesce(n_stop / nullif(n_words, 0), 0) AS stop_word_ratio,
         coalesce(n_bullet / nullif(n_lines, 0), 0) AS bullet_line_ratio, coalesce(n_cut / nullif(n_lines, 0), 0) AS ellipsis_line_ratio
  FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       (NOT base_failed AND NOT ({broken})) AS kept
FROM k"""


@query(_quality_sql())
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold table over every document."""
    from .quality import quality

    return quality(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _secret_sql() -> str:
    # (kind, pattern, group, least characters): the contract's own three, then the rules that the method adds
    rules = (
        ("assign", r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
        ("access", "AKIA[A-Z0-9]+", 0, 18),
        ("hex", "[0-9a-f]+", 0, 16),
        ("private_key", "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 0),
        ("gh_token", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
        ("chat_token", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
        ("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}", 0, 0),
        ("map_key", "AIza[A-Za-z0-9_-]{35}", 0, 0),
    )

    def spans(i, kind, p, group, least):
        return f"""
  SELECT doc_id, {i} AS k, '{kind}' AS kind, CAST(coalesce(list_sum(list_transform(g[1:j], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:j-1], lambda x: length(x))), 0) AS BIGINT) AS s, length(m[j]) AS n
  FROM (SELECT doc_id, g, m, v, unnest(range(1, len(m) + 1)) AS j FROM
    (SELECT doc_id, string_split_regex(t, '{p}') AS g, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS v FROM b))
  WHERE length(v[j]) >= {least}"""

    found = " UNION ALL ".join(spans(i, *r) for i, r in enumerate(rules))
    return f"""
WITH b AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({found}),
a AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
         string_agg(concat(kind, ':', s, ':', s + n), ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(concat(kind, ':', s, ':', s + n), ',' ORDER BY s, k) AS spans
  FROM f GROUP BY doc_id)
SELECT b.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM b LEFT JOIN a ON b.doc_id = a.doc_id"""


@query(_secret_sql())
def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All spans of every document."""
    from .secret_scan import BASE_RULES, RULES, joined, scan

    s = scan(table(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("spans", lambda x: x["kind"] < len(BASE_RULES))
    return s.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(joined(base, RULES), 256).alias("base_sha256"), joined(F.col("spans"), RULES).alias("spans"))


def _url_sql() -> str:
    contract = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
    rules = " UNION ALL ".join(f"SELECT '{r}' AS rule, '{r.partition('/')[0]}' AS rh, '/{r.partition('/')[2]}' AS rp, '{v}' AS rv" for r, v in contract)
    suffixes = (
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
    listed = lambda mark, cut: ", ".join(f"'{x[cut:]}'" for x in suffixes if (x[0] == mark if mark else x[0] not in "*!"))
    usual = "^(ac|co|com|edu|go|gob|gouv|gov|gv|ltd|mil|ne|net|nom|or|org|plc|sch)[.][a-z][a-z]$|^((cc|k12|lib)[.])?[a-z][a-z][.]us$"
    end = lambda k: f"array_to_string(l[-{k}:], '.')"
    is_rule = lambda k: f"len(l) >= {k} AND ({end(k)} IN ({listed('', 0)}) OR regexp_matches({end(k)}, '{usual}')" + (f" OR {end(k - 1)} IN ({listed('*', 2)})" if k > 1 else "") + ")"
    n_labels = f"CASE WHEN len(l) >= 3 AND {end(3)} IN ({listed('!', 1)}) THEN 2 WHEN len(l) >= 2 AND {end(2)} IN ({listed('!', 1)}) THEN 1 " + " ".join(f"WHEN {is_rule(k)} THEN {k}" for k in (4, 3, 2)) + " ELSE 1 END"
    rho = "least(greatest((q - n * p * p - p * (1 - p) * (g - 1)) / (p * (1 - p) * (n - nn / n - (g - 1))), 0.001), 0.999)"
    k = lambda name, t: f"""{name} AS (SELECT CASE WHEN g < 2 OR p * (1 - p) <= 0 OR n - nn / n - (g - 1) <= 0 THEN 2.0 ELSE 1 / ({rho}) - 1 END AS k, p
  FROM (SELECT count(*) AS g, sum(n)::DOUBLE AS n, sum(n * n)::DOUBLE AS nn, sum(bad * bad / n) AS q, sum(bad) / sum(n) AS p FROM {t}))"""  # noqa: E731
    return rf"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
b AS (
  SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM u),
hd AS (
  SELECT host, CASE WHEN num THEN bare ELSE array_to_string(l[-(n + 1):], '.') END AS domain, CASE WHEN num THEN '' ELSE array_to_string(l[-n:], '.') END AS suffix
  FROM (SELECT *, {n_labels} AS n
        FROM (SELECT host, bare, string_split(bare, '.') AS l, regexp_matches(bare, '^[0-9.]+$|^\[') AS num FROM (SELECT DISTINCT host, regexp_replace(regexp_replace(host, '^.*@', ''), '(:[0-9]*|\.)$', '') AS bare FROM b)))),
h AS (SELECT host, domain, suffix, count(*) AS n, sum(toxic)::BIGINT AS bad FROM b JOIN labels ON page_id = doc_id JOIN hd USING (host) WHERE toxic IS NOT NULL GROUP BY ALL),
d AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM h GROUP BY ALL),
{k('ks', 's')}, {k('kd', 'd')}, {k('kh', 'h')},
r AS (
  SELECT host, m, n0 + kh.k AS total FROM (
    SELECT host, coalesce(h.n, 0) AS n0, (coalesce(h.bad, 0) + kh.k * md) / (coalesce(h.n, 0) + kh.k) AS m FROM (
      SELECT hd.host, (coalesce(d.bad, 0) + kd.k * ms) / (coalesce(d.n, 0) + kd.k) AS md FROM (
        SELECT hd.host, hd.domain, (coalesce(s.bad, 0) + ks.k * ks.p) / (coalesce(s.n, 0) + ks.k) AS ms FROM hd LEFT JOIN s USING (suffix), ks) hd LEFT JOIN d USING (domain), kd) x
    LEFT JOIN h USING (host), kh), kh),
rules AS ({rules}),
f AS (SELECT page_id, rule, rv, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC, rule DESC) AS o
      FROM b JOIN rules ON (host = rh OR ends_with(host, concat('.', rh))) AND starts_with(path, rp))
SELECT b.page_id, b.host, b.path, f.rule, coalesce(rv, CASE WHEN m - 1.645 * sqrt(m * (1 - m) / (total + 1)) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM b LEFT JOIN f ON b.page_id = f.page_id AND o = 1 LEFT JOIN r ON b.host = r.host"""


@query(_url_sql())
def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page.

    The tables have no outcomes of pages.  Those of ``labels`` stand in for them: the label of
    the same number is the page's outcome (toxic: bad), so that the method has something to learn.
    """
    from .url_filter import judge

    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("toxic").alias("bad"))
    return judge(table(spark, sf_dir, "pages"), outcomes).select("page_id", "host", "path", "rule", "verdict")


@query()
def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the components of links at two bits or fewer."""
    from .simhash import simhash

    return simhash(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def vocabulary() -> str:
    """The public vocabulary file that the contracts name."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


@query()
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 ids."""
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary())


@query()
def op8_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids written to files and read back."""
    from .token_codec import encode_corpus, read_files

    return read_files(encode_corpus(table(spark, sf_dir, "documents"), vocabulary())).select("doc_id", "start", "n_tokens", "ids_crc32")


@query("""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha256(h) AS digest FROM p),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f""")
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back."""
    from .warc import read_archives, write_archives

    return read_archives(write_archives(table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def pieces() -> str:
    """The public piece vocabulary of the language models."""
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


@query()
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those that aren't held out."""
    from .langid import fit, identify, is_held_out

    docs = table(spark, sf_dir, "documents")
    out = identify(docs, fit(docs, pieces()), pieces())
    return out.select("doc_id", is_held_out("doc_id").alias("held_out"), "lang_pred", "score")


def _decontamination_sql() -> str:
    # the operator's documented rules, written out once more
    units = (
        "kg|g|mg|lb|lbs|oz|ton|tons|km|m|cm|mm|mile|miles|foot|feet|ft|inch|inches|yard|yards|second|seconds|minute|minutes|hour|hours|day|days|week|weeks|"
        "month|months|year|years|dollar|dollars|euro|euros|cent|cents|percent|liter|liters|litre|litres|ml|gallon|gallons|degree|degrees|mph|kmh"
    )
    frequent = (
        "the|this|that|these|those|there|they|then|than|what|when|where|which|who|whose|why|how|if|in|is|it|its|an|and|are|as|at|by|do|does|did|each|every|find|for|from|give|given|had|has|have|he|her|his|she|"
        "let|many|much|no|not|of|on|one|our|some|to|two|was|we|were|with|you|your|after|all|because|before|but|can|consider|calculate|compute|determine|during|der|die|das|ein|eine|einen|er|sie|es|wir|ihr|ich|und|oder|aber|wenn|"
        "als|wie|wer|wo|warum|welche|welcher|welches|dann|im|am|auf|aus|bei|mit|nach|von|vor|zu|nicht|le|la|les|un|une|des|il|elle|nous|vous|je|et|ou|mais|si|que|qui|quoi|quand|comment|pourquoi|combien|quel|dans|avec|"
        "pour|sur|ce|ces|el|los|las|una|nosotros|pero|como|donde|cuando|quien|cual|cuantos|porque|con|para|por|sobre|este|esta|en"
    )
    numerals = (
        "one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand|million|"
        "zwei|drei|vier|fünf|sechs|sieben|acht|neun|zehn|elf|zwölf|zwanzig|hundert|tausend|"
        "deux|trois|quatre|cinq|sept|huit|neuf|dix|onze|douze|treize|quatorze|quinze|seize|vingt|trente|quarante|cinquante|soixante|mille|"
        "dos|tres|cuatro|cinco|seis|siete|ocho|nueve|diez|doce|trece|catorce|veinte|treinta|cuarenta|cincuenta|cien|mil"
    )
    number = r"(?:[0-9]+(?:[.,][0-9]+)*\p{L}*|\x04[\p{L}\p{N}]+)"
    token = rf"{number}(?:[ ,;-]+{number})*|\x02[\p{{L}}\p{{N}}]+(?: \x02[\p{{L}}\p{{N}}]+)*|\x03?[\p{{L}}\p{{N}}]+"
    capital = "|".join(dict.fromkeys(w[0].upper() + w[1:] for w in f"{frequent}|{numerals}".split("|")))
    # all capitalised words are marked, then the mark is taken from frequent ones (twice, as the character behind one is consumed)
    name = rf"regexp_replace(t, '(^|[^\p{{L}}\p{{N}}])(\p{{Lu}}\p{{Ll}})', concat('\1', chr(2), '\2'), 'g')"
    unname = lambda t: rf"regexp_replace({t}, '\x02({capital})([^\p{{L}}\p{{N}}]|$)', '\1\2', 'g')"
    count = lambda t: rf"regexp_replace({t}, '(^|[^\p{{L}}\p{{N}}\x02])({numerals})([^\p{{L}}\p{{N}}]|$)', concat('\1', chr(4), '\2\3'), 'g')"
    first = lambda t: rf"regexp_replace({t}, '^([^\p{{L}}\p{{N}}\x02]*)\x02', '\1')"  # noqa: E731  never the first word
    # names inside a sentence: twice, as a name of two letters is consumed with what stands before the next one
    inner = lambda t: rf"regexp_replace({t}, '([\p{{L}}\p{{N}},;)] )(\p{{Lu}}\p{{Ll}})', concat('\1', chr(2), '\2'), 'g')"
    is_number = "((x >= '0' AND x < ':') OR starts_with(x, chr(4)))"

    def texts(to: str, table: str, id_col: str, names: str) -> str:
        return rf"""
{to}_w AS (SELECT id, regexp_extract_all(regexp_replace({count(count(f"lower({names})"))}, '([0-9] ?)({units})([^\p{{L}}]|$)', concat('\1', chr(3), '\2\3'), 'g'), '{token}') AS w
  FROM (SELECT {id_col} AS id, regexp_replace(coalesce(text, ''), '[\x02-\x04]', '', 'g') AS t FROM {table})),
{to}_l AS (SELECT id, w, list_transform(w, lambda x: CASE WHEN {is_number} THEN '<num>' WHEN starts_with(x, chr(2)) THEN '<name>' WHEN starts_with(x, chr(3)) THEN '<unit>' ELSE x END) AS t,
    list_transform(w, lambda x: CASE WHEN {is_number} OR starts_with(x, chr(2)) OR starts_with(x, chr(3)) THEN replace(replace(replace(x, chr(2), ''), chr(3), ''), chr(4), '') END) AS v FROM {to}_w WHERE len(w) > 0)"""

    def windows(of: str, n: str, where: str) -> str:
        """Windows of n words; shorter texts are one."""
        return f"""SELECT id, p, v[p+1:p+{n}] AS v, CASE WHEN len(list_filter(v[p+1:p+{n}], lambda x: x IS NOT NULL)) > {n} - 3 THEN concat('words ', array_to_string(w[p+1:p+{n}], ' ')) ELSE array_to_string(t[p+1:p+{n}], ' ') END AS h
  FROM (SELECT id, t, v, w, unnest(range(0, greatest(len(t) - {n} + 1, 1))) AS p FROM {of}_l WHERE {where})"""

    everywhere, inside = first(unname(unname(name))), inner(inner("t"))
    short = " UNION ALL ".join(
        f"""SELECT d.id, i.id AS item, 1 AS n, i.p AS spot, d.p - i.p AS place, i.v AS a, d.v AS b FROM ({windows("e", str(n), f"len(t) >= {n}")}) d
  JOIN ({windows("c", str(n), f"len(t) = {n} AND id IN (SELECT id FROM b_l WHERE len(t) < 8)")}) i ON d.h = i.h""" for n in range(4, 13)
    )
    return f"""
WITH {texts("d", "documents", "doc_id", everywhere)}, {texts("b", "benchmark", "item_id", everywhere)}, {texts("e", "documents", "doc_id", inside)}, {texts("c", "benchmark", "item_id", inside)},
dw AS (SELECT *, CASE WHEN c < 8 THEN 'whole' END AS k FROM ({windows("d", "8", "true")}) JOIN (SELECT id, len(t) AS c FROM d_l) USING (id)),
bw AS (SELECT *, CASE WHEN c < 8 THEN 'whole' END AS k, count(*) OVER (PARTITION BY id) AS n FROM ({windows("b", "8", "true")}) JOIN (SELECT id, len(t) AS c FROM b_l) USING (id)),
hits AS (SELECT d.id, i.id AS item, n, i.p AS spot, d.p - i.p AS place, i.v AS a, d.v AS b FROM dw d JOIN bw i ON d.h = i.h AND d.k IS NOT DISTINCT FROM i.k UNION ALL {short}),
g AS (SELECT *, unnest([{{'kind': 0, 'line': place}}, {{'kind': 1, 'line': CAST(floor(place / 8) AS BIGINT)}}, {{'kind': 2, 'line': CAST(floor((place + 4) / 8) AS BIGINT)}}]) AS g FROM hits),
seen AS (SELECT id, item, n, g, count(DISTINCT spot) AS matched, min(place) AS place FROM g GROUP BY id, item, n, g),
vals AS (SELECT DISTINCT id, item, n, g, x, y FROM (SELECT id, item, n, g, unnest(a) AS x, unnest(b) AS y FROM g) WHERE x IS NOT NULL),
cons AS (SELECT id, item, n, g, count(DISTINCT x) = count(*) AND count(DISTINCT y) = count(*) AS ok, count(*) FILTER (x <> y) AS changed FROM vals GROUP BY id, item, n, g),
good AS (SELECT s.*, coalesce(changed, 0) AS changed FROM seen s LEFT JOIN cons c ON s.id = c.id AND s.item = c.item AND s.n = c.n AND s.g = c.g
  WHERE matched >= least(ceil(s.n * 0.5), 25) AND coalesce(ok, true))
SELECT id AS doc_id, item AS item_id, CAST(matched AS BIGINT) AS matched, CAST(n AS BIGINT) AS windows, CAST(place AS BIGINT) AS place, CAST(changed AS BIGINT) AS changed FROM
  (SELECT *, row_number() OVER (PARTITION BY id, item ORDER BY matched DESC, place, n DESC, changed) AS o FROM good) WHERE o = 1"""


@query(_decontamination_sql())
def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item."""
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that several documents hold."""
    from .compact_windows import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def byte_vocabulary() -> str:
    """The public byte-level BPE file."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


@query()
def op13_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded, and its ids decoded again."""
    from .bpe import decode, encode

    out = decode(encode(table(spark, sf_dir, "documents"), byte_vocabulary()), byte_vocabulary(), keep=("doc_id", "ids"))
    shown = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(shown, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query()
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's tokens of two vocabularies, aligned."""
    from .alignment import align

    texts, _ = align(table(spark, sf_dir, "documents"), byte_vocabulary(), pieces(), digest=True)
    return texts.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _vector_sql() -> str:
    def nearest(t: int) -> str:
        """Of each part the smallest distance and, below it, the smallest number: distance * 256 + number."""
        return f"""a{t} AS MATERIALIZED (
  SELECT r, p, min(d) AS best FROM (SELECT x.r, x.p, sum((v - m) * (v - m)) * 256 + c AS d FROM x JOIN c{t} USING (p, j) GROUP BY x.r, x.p, c) GROUP BY r, p)"""

    rounds = ",\n".join(
        f"""{nearest(t)},
c{t + 1} AS MATERIALIZED (
  SELECT c{t}.p, c{t}.c, c{t}.j, coalesce((s - ((s % n) + n) % n) // n, m) AS m FROM c{t} LEFT JOIN (
    SELECT x.p, CAST(best % 256 AS BIGINT) AS c, j, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM x JOIN a{t} ON x.r = a{t}.r AND x.p = a{t}.p GROUP BY ALL) u
  ON c{t}.p = u.p AND c{t}.c = u.c AND c{t}.j = u.j)"""
        for t in range(4)
    )
    return f"""
WITH k AS MATERIALIZED (
  SELECT vec_id, label, embedding AS e, row_number() OVER (ORDER BY vec_id, embedding) - 1 AS r FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
x AS MATERIALIZED (
  SELECT r, i // (len(e) // 4) AS p, i % (len(e) // 4) AS j, CAST(floor(1024 * CAST(e[i + 1] AS DOUBLE)) AS BIGINT) AS v FROM (SELECT r, e, unnest(range(len(e))) AS i FROM k)),
c0 AS MATERIALIZED (SELECT p, r AS c, j, v AS m FROM x WHERE r < 256),
{rounds},
{nearest(4)},
f AS (SELECT r, string_agg(format('{{:02x}}', CAST(best % 256 AS BIGINT)), '' ORDER BY p) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM a4 GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(m, ',' ORDER BY p, c, j)) FROM c4) AS codebooks_sha256
FROM k JOIN f USING (r)"""


@query(_vector_sql())
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors by codebooks learnt from all of them."""
    from .vector_codes import compress

    coded, books = compress(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
