"""Queries of the library's own operators over the project's tables, each beside the SQL it is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirmill.functions import html, urls
from weirmill.functions.hosts import host, with_registrable
from weirmill.functions.text import CLAIMS, REQUESTS, category, claims, requests
from weirmill.functions.text import label as label_of
from weirmill.operators import audit, contract, groups, matching, metrics, models
from weirmill.plans.sql import URLS
from weirmill.plans.sql import category as category_sql
from weirmill.plans.sql import host as host_sql
from weirmill.plans.sql import label as label_sql
from weirmill.plans.tables import table, url_records
from weirmill.session import scratch_path, write_table
from weirmill.streaming import navigation

CLAIMS_ANY = "|".join(CLAIMS.values())
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
DIMS = ["label", "source", "tier", "scenario", "split", "lang"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Audit


@query(" union all ".join(f"select '{d}' as dim, {d} as value, count(*) as n from url_audit group by {d}" for d in DIMS))
def audit_counts(spark: SparkSession, d: str) -> DataFrame:
    return audit.value_counts(table(spark, d, "url_audit"), DIMS)


@query("select source, label, count(*) as n from url_audit group by all")
def audit_cross_counts(spark: SparkSession, d: str) -> DataFrame:
    return audit.cross_counts(table(spark, d, "url_audit"), "source", "label")


@query("select scenario, count(*) as n from url_audit where label = 'phishing' group by all")
def audit_filtered_counts(spark: SparkSession, d: str) -> DataFrame:
    return audit.filtered_counts(table(spark, d, "url_audit"), F.col("label") == "phishing", "scenario")


@query("select count(*) as rows, count(distinct domain) + max(case when domain is null then 1 else 0 end) as distinct_values from url_audit")
def audit_distinct(spark: SparkSession, d: str) -> DataFrame:
    return audit.distinct_values(table(spark, d, "url_audit"), "domain")


@query()
def audit_report_json(spark: SparkSession, d: str) -> DataFrame:
    return audit.report(table(spark, d, "url_audit"), DIMS, "domain", ("source", "label"), F.col("label") == "phishing", "scenario")


@query("select doc_id, sha256(text) as sha256, octet_length(encode(text)) as bytes from documents")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"))


_DIGEST = "sha256(concat_ws(chr(31), " + ", ".join(f"coalesce(cast({c} as varchar), chr(0))" for c in ["record_id", *DIMS, "domain"]) + "))"


@query(f"""with p as (select ('0x' || substr({_DIGEST}, 1, 15))::bigint as p from url_audit), g as (select count(*) as rows, coalesce(sum(p), 0)::hugeint as s, coalesce(bit_xor(p), 0) as x from p) select rows, sha256(concat_ws('|', rows, s, x)) as sha256 from g""")
def table_digest(spark: SparkSession, d: str) -> DataFrame:
    return audit.digest(table(spark, d, "url_audit"), ["record_id", *DIMS, "domain"])


@query("""with c as (select nullif(trim(date), '') as raw from corpus), p as (select raw, case when regexp_matches(raw, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') then try_cast(raw[:10] as date) end as d from c)
select cast(date_trunc('month', d) as date) as month, count(*) as rows, count(*) filter (raw is null) as missing, count(*) filter (raw is not null and d is null) as invalid, min(d) as "first", max(d) as "last" from p group by 1""")
def date_audit(spark: SparkSession, d: str) -> DataFrame:
    return audit.date_audit(table(spark, d, "corpus"), "date")


@query("select source_split, count(*) as n from sample_index where date_status = 'valid' and collected_at between date '2024-10-01' and date '2025-12-31' group by all")
def date_window(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sample_index").filter((F.col("date_status") == "valid") & F.col("collected_at").between("2024-10-01", "2025-12-31"))
    return s.groupBy("source_split").agg(F.count("*").alias("n"))


_D = f"select {category_sql('source')} as source, {category_sql('lang')} as lang, {label_sql('label')} as label, text from documents"


@query(f"""select concat_ws('+', case when grouping(source) = 0 then 'source' end, case when grouping(lang) = 0 then 'lang' end, case when grouping(label) = 0 then 'label' end) as level,
source, lang, label, count(*) as rows, count(*) filter (text = '') as empty, count(*) filter (text is null) as missing from ({_D}) group by cube (source, lang, label)""")
def quality_cube(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select(category(F.col("source")).alias("source"), category(F.col("lang")).alias("lang"), label_of(F.col("label")).alias("label"), "text")
    return audit.quality_cube(t, ["source", "lang", "label"], empty=F.col("text") == "", missing=F.col("text").isNull())


@query("""select source_split, reason, count(*) as n from (select source_split, case when exclusion_reason is not null then 'excluded' when date_status <> 'valid' then 'date' when language is null then 'language' end as reason from sample_index) group by all""")
def exclusion_log(spark: SparkSession, d: str) -> DataFrame:
    s = audit.accepted(table(spark, d, "sample_index"), {"excluded": F.col("exclusion_reason").isNotNull(), "date": F.col("date_status") != "valid", "language": F.col("language").isNull()})
    return s.groupBy("source_split", "reason").agg(F.count("*").alias("n"))


@query("select count(*) as rows, count(*) filter (html_chars > 0) as with_html, count(*) filter (text_chars > 0) as with_text, count(*) filter (forms > 0) as with_form, count(*) filter (inputs > 0 and forms = 0) as loose_inputs from pilot_profile")
def pilot_counts(spark: SparkSession, d: str) -> DataFrame:
    c = lambda x, n: F.count_if(F.expr(x)).alias(n)
    return table(spark, d, "pilot_profile").agg(F.count("*").alias("rows"), c("html_chars > 0", "with_html"), c("text_chars > 0", "with_text"), c("forms > 0", "with_form"), c("inputs > 0 and forms = 0", "loose_inputs"))


@query(f"with {URLS} select source, count(distinct record_id) as records, count(distinct host) as hosts, count(distinct label) = 2 as both_classes from u where label in ('phishing', 'benign') group by source having count(distinct host) >= 5")
def source_guard(spark: SparkSession, d: str) -> DataFrame:
    u = url_records(spark, d).filter(F.col("label").isin("phishing", "benign"))
    return u.groupBy("source").agg(F.count_distinct("record_id").alias("records"), F.count_distinct("host").alias("hosts"), (F.count_distinct("label") == 2).alias("both_classes")).filter("hosts >= 5")


@query("select label, count(*) as n, round(avg(html_chars), 6) as mean_html, round(quantile_cont(html_chars, 0.5), 6) as median_html, round(stddev_samp(html_chars), 6) as sd_html from pilot_profile group by label")
def html_distribution(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("html_chars")
    return table(spark, d, "pilot_profile").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(h), 6).alias("mean_html"), F.round(F.percentile(h, 0.5), 6).alias("median_html"), F.round(F.stddev_samp(h), 6).alias("sd_html"))


# URLs and hosts


@query("""with c as (select sha256, trim(url) as u from corpus), s as (select sha256, u, case when u is null or u = '' then 'invalid' when length(u) > 8192 then 'too_long' when regexp_full_match(u, '(?i)https?://[^\\s/?#]+[^\\s]*') then 'ok'
when regexp_full_match(u, '[0-9A-Za-z_-]+(\\.[0-9A-Za-z_-]+)+([/?#:][^\\s]*)?') then 'scheme_added' else 'invalid' end as url_status from c),
r as (select sha256, url_status, regexp_replace(regexp_replace(case url_status when 'ok' then u when 'scheme_added' then 'http://' || u end, '#.*$', ''), '^([A-Za-z]+://)[^/?#]*@', '\\1') as u from s)
select sha256, url_status, lower(regexp_extract(u, '^[A-Za-z]+://[^/?]*')) || regexp_extract(u, '^[A-Za-z]+://[^/?]*([^?]*)', 1) || case when regexp_extract(u, '\\?(.*)$', 1) = '' then '' else '?' || regexp_replace(regexp_extract(u, '\\?(.*)$', 1), '=[^&]*', '=*', 'g') end as url from r""")
def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "corpus")
    return c.select("sha256", urls.status(F.col("url")).alias("url_status"), urls.normalize(F.col("url")).alias("url"))


_NORMAL = """c as (select sha256, trim(url) as u from corpus), s as (select sha256, u, case when u is null or u = '' or length(u) > 8192 then null when regexp_full_match(u, '(?i)https?://[^\\s/?#]+[^\\s]*') then u
when regexp_full_match(u, '[0-9A-Za-z_-]+(\\.[0-9A-Za-z_-]+)+([/?#:][^\\s]*)?') then 'http://' || u end as r from c), x as (select sha256, u, regexp_replace(regexp_replace(r, '#.*$', ''), '^([A-Za-z]+://)[^/?#]*@', '\\1') as r from s),
n as (select sha256, u, lower(regexp_extract(r, '^[A-Za-z]+://[^/?]*')) || regexp_extract(r, '^[A-Za-z]+://[^/?]*([^?]*)', 1) || case when regexp_extract(r, '\\?(.*)$', 1) = '' then '' else '?' || regexp_replace(regexp_extract(r, '\\?(.*)$', 1), '=[^&]*', '=*', 'g') end as n from x),
p as (select *, nullif(regexp_replace(regexp_extract(n, '^[a-z]+://([^/?:]*)', 1), '\\.$', ''), '') as host, regexp_extract(n, '^[a-z]+://[^/?]*([^?]*)', 1) as path, regexp_extract(n, '\\?(.*)$', 1) as q from n)"""


@query(f"""with {_NORMAL} select sha256, lower(regexp_extract(n, '^([A-Za-z]+)://', 1)) as scheme, host, case when n is not null then path end as path, case when n is not null then array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(q, '&'), lambda v: regexp_extract(v, '^([^=]*)', 1)), lambda v: v <> ''))), ',') end as param_names,
length(n) as url_chars, length(host) as host_chars, len(string_split(host, '.')) as host_labels, len(regexp_extract_all(n, '[0-9]')) as digits, len(regexp_extract_all(host, '-')) as hyphens, len(regexp_extract_all(case when n is not null then path end, '/[^/]')) as path_depth, len(regexp_extract_all(n, '=\\*')) as parameters,
regexp_matches(u, '^[A-Za-z]+://[^/?#]*@') as has_user, regexp_full_match(host, '[0-9]+(\\.[0-9]+){{3}}') as is_ip from p""")
def url_lexical(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "corpus").select("sha256", urls.scheme(u).alias("scheme"), urls.host_of(u).alias("host"), urls.path(u).alias("path"), urls.param_names(u).alias("param_names"), *(c.alias(n) for n, c in urls.lexical(u).items()))


@query(f"with {URLS} select host, count(*) as rows, count(distinct record_id) as records from u group by host")
def host_counts(spark: SparkSession, d: str) -> DataFrame:
    return url_records(spark, d).groupBy("host").agg(F.count("*").alias("rows"), F.count_distinct("record_id").alias("records"))


_PSL = """p as (select host, string_split(host, '.') as l from h), s as (select host, l, k, array_to_string(l[len(l) - k + 1:], '.') as suffix from (select host, l, unnest(range(1, len(l) + 1)) as k from p)),
m as (select s.host, any_value(l) as l, max(case when kind = 'rule' then k when kind = 'wildcard' and len(l) > k then k + 1 end) as n, max(case when kind = 'exception' then k end) as e from s join psl on s.suffix = psl.suffix group by s.host),
r as (select host, case when e is not null then array_to_string(l[len(l) - e + 1:], '.') when n < len(l) then array_to_string(l[len(l) - n:], '.') end as registrable from m)"""


@query(f"with {URLS}, h as (select distinct host from u where host is not null), {_PSL} select h.host, registrable from h left join r on h.host = r.host")
def registrable_domain(spark: SparkSession, d: str) -> DataFrame:
    return with_registrable(url_records(spark, d).select("host").filter("host is not null").distinct(), "host", table(spark, d, "psl"))


@query(f"""with {URLS}, h as (select distinct host from u where host is not null), q as (select distinct lower(suffix) as suffix, case when section = 'private' then 'user_content_hosting' else 'registry' end as role from psl where kind <> 'exception'),
m as (select host, suffix, role, row_number() over (partition by host order by length(suffix) desc, role desc) as i from h join q on host = suffix or ends_with(host, '.' || suffix)) select host, suffix as rule_host, role from m where i = 1""")
def boundary_match(spark: SparkSession, d: str) -> DataFrame:
    """The longest listed suffix of every host at a label boundary, and who gives out names below it."""
    role = F.when(F.col("section") == "private", "user_content_hosting").otherwise("registry")
    rules = table(spark, d, "psl").filter("kind <> 'exception'").select(F.lower("suffix").alias("hostname"), role.alias("role"), F.lit(None).cast("string").alias("org_id")).distinct()
    return matching.boundary_matches(url_records(spark, d).select("host"), "host", rules).drop("org_id")


# Pages


@query(r"""with c as (select sha256, html, regexp_replace(html, '(?is)<!--.*?-->|<(script|style)[^>]*>.*?</(script|style)>|<title[^>]*>.*?</title>', ' ', 'g') as b from corpus)
select sha256, length(html) as html_chars, length(trim(regexp_replace(regexp_replace(b, '(?s)<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))) as text_chars, coalesce(len(regexp_extract_all(html, '(?i)<form[ >]')), 0) as forms, coalesce(len(regexp_extract_all(html, '(?i)<input[ >]')), 0) as inputs,
coalesce(len(regexp_extract_all(html, '(?i)<input[^>]*type="password"')), 0) as password_inputs, coalesce(len(regexp_extract_all(html, '(?i)<a [^>]*href=')), 0) as links, coalesce(len(regexp_extract_all(html, '(?i)<script[ >]')), 0) as scripts from c""")
def page_patterns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "corpus").select("sha256", *(c.alias(n) for n, c in html.pattern_profile(F.col("html")).items()))


def _tags(name: str, more: str = "") -> str:
    return f"coalesce(len(regexp_extract_all(b, '(?i)<{name}(?:\\s[^>]*)?{more}>')), 0)"


@query(f"""with c as (select sha256, html, regexp_replace(html, '(?is)<!--.*?(?:-->|$)|<(script|style)[^>]*>.*?(?:</(script|style)>|$)', ' ', 'g') as b from (select distinct sha256, html from corpus))
select sha256, length(html) as html_chars, {_tags('form')} as forms, {_tags('input')} as inputs, coalesce(len(regexp_extract_all(b, '(?i)<input\\s[^>]*type="password"[^>]*>')), 0) as password_inputs, {_tags('iframe')} as iframes,
coalesce(len(regexp_extract_all(b, '(?i)<a\\s[^>]*href=[^>]*>')), 0) as links from c""")
def page_profile(spark: SparkSession, d: str) -> DataFrame:
    """Parser counts of every distinct page, null and truncated ones too: what patterns in SQL can check of ``page_parsed``."""
    c = table(spark, d, "corpus").select("sha256", "html").distinct()
    p = c.withColumn("p", html.profile(F.col("html")))
    return p.select("sha256", F.length("html").alias("html_chars"), "p.forms", "p.inputs", "p.password_inputs", "p.iframes", F.size("p.links").alias("links"))


@query()
def page_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Parser profile, all fields, of every distinct page: null and truncated pages too."""
    c = table(spark, d, "corpus").select("sha256", "html").distinct()
    return c.withColumn("p", html.profile(F.col("html"))).select("sha256", F.length("html").alias("html_chars"), "p.*")


_ENDS = [f"{kind}_{where}" for kind in ("action", "link") for where in ("own", "related", "foreign")]


def _ends(field: str):
    """Addresses of a page as ``(kind, to)``."""
    return F.transform(field, lambda a: F.struct(F.lit(field.rstrip("s")).alias("kind"), a.alias("to")))


@query()
def page_signals(spark: SparkSession, d: str) -> DataFrame:
    """Whether a page asks for a password or a code, and where its forms and links lead: the page's own host, a related one of
    the same registrable domain, or a foreign one. Addresses without a host are the page's own."""
    psl = table(spark, d, "psl")
    c = table(spark, d, "corpus").select("sha256", "url", "html").distinct().withColumn("host", host(F.col("url")))
    p = with_registrable(c.withColumn("p", html.profile(F.col("html"))).select("sha256", "url", "host", "p.*"), "host", psl)
    p = write_table(p.withColumn("page", F.xxhash64("sha256", "url")), "parsed_pages")
    ends = p.select("page", "host", "registrable", F.inline(F.concat(_ends("actions"), _ends("links"))))
    ends = with_registrable(ends.select("page", "kind", F.col("host").alias("own"), F.col("registrable").alias("own_domain"), F.when(F.col("to").rlike("^(?i)(https?:)?//"), host(F.col("to"))).alias("to_host")), "to_host", psl, "to_domain")
    where = F.when(F.col("to_host").isNull() | (F.col("to_host") == F.col("own")), "own").when(F.col("to_domain") == F.col("own_domain"), "related").otherwise("foreign")
    per = ends.select("page", F.concat("kind", F.lit("_"), where).alias("k")).groupBy("page").agg(*(F.count_if(F.col("k") == k).alias(k) for k in _ENDS))
    got = p.join(per, "page", "left")
    return got.select("sha256", "host", (F.col("password_inputs") > 0).alias("sensitive_form"), requests(F.col("text")).alias("request_phrase"), *(F.coalesce(k, F.lit(0)).alias(k) for k in _ENDS))


@query()
def page_sanitized(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "corpus").select("sha256", "html").distinct().select("sha256", html.sanitize(F.col("html")).alias("html_clean"))


# Names


@query()
def alias_exact(spark: SparkSession, d: str) -> DataFrame:
    return matching.alias_readings(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "dictionary"))


@query()
def alias_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return matching.fuzzy_aliases(table(spark, d, "corpus"), "target", table(spark, d, "dictionary"))


@query("""with n as (select org_id, lower(unnest(list_concat([display_name], aliases, service_names))) as name from dictionary), m as (select name, min(org_id) as org_id from n group by name)
select coalesce(org_id, 'unknown') as org_id, count(*) as n from corpus left join m on lower(trim(target)) = name where target is not null group by 1""")
def service_to_org(spark: SparkSession, d: str) -> DataFrame:
    dic = table(spark, d, "dictionary")
    m = dic.select("org_id", F.explode(F.concat(F.array("display_name"), "aliases", "service_names")).alias("n")).groupBy(F.lower("n").alias("name")).agg(F.min("org_id").alias("org_id"))
    c = table(spark, d, "corpus").filter("target is not null")
    return c.join(matching.checked_broadcast(m), F.lower(F.trim("target")) == F.col("name"), "left").groupBy(F.coalesce("org_id", F.lit("unknown")).alias("org_id")).agg(F.count("*").alias("n"))


@query("""select sample_id, s.collected_at, count(org_id) as known_orgs from sample_index s left join dictionary d on d.verified_at <= s.collected_at and (d.valid_from is null or d.valid_from <= s.collected_at) and (d.valid_to is null or d.valid_to >= s.collected_at) group by all""")
def dictionary_as_of(spark: SparkSession, d: str) -> DataFrame:
    """Organisations valid and verified on each sample's day: resolved once a day, then joined by day."""
    s, dic = table(spark, d, "sample_index").select("sample_id", "collected_at"), table(spark, d, "dictionary")
    days = s.filter("collected_at is not null").select("collected_at").distinct()
    valid = (F.col("verified_at") <= F.col("collected_at")) & (F.col("valid_from").isNull() | (F.col("valid_from") <= F.col("collected_at"))) & (F.col("valid_to").isNull() | (F.col("valid_to") >= F.col("collected_at")))
    per = days.join(matching.checked_broadcast(dic), valid).groupBy(F.col("collected_at").alias("day")).agg(F.count("org_id").alias("known_orgs"))
    return s.join(per, F.col("collected_at") == F.col("day"), "left").select("sample_id", "collected_at", F.coalesce("known_orgs", F.lit(0)).alias("known_orgs"))


@query("""select o.o_orderkey, o.o_custkey, p.o_totalprice as last_price from (select o_orderkey, o_custkey, o_orderdate - interval 30 day as t from orders) o asof left join (select o_custkey, o_orderdate, max(o_totalprice) as o_totalprice from orders group by all) p on o.o_custkey = p.o_custkey and o.t >= p.o_orderdate""")
def as_of_join(spark: SparkSession, d: str) -> DataFrame:
    """The customer's latest order price at least thirty days before each order."""
    o = table(spark, d, "orders")
    left = o.select("o_orderkey", "o_custkey", (F.col("o_orderdate") - F.expr("interval 30 days")).alias("t"))
    return matching.as_of(left, o.select("o_custkey", "o_orderdate", "o_totalprice"), "o_custkey", "t", "o_orderdate", "o_totalprice", "last_price").select("o_orderkey", "o_custkey", "last_price")


# Groups


@query("with h as (select doc_id as id, sha256(text) as h from documents where text is not null), g as (select h, min(id) as class_id, count(*) as copies from h group by h) select id, class_id, copies from h join g using (h)")
def exact_duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    return groups.exact_duplicates(table(spark, d, "documents"), "doc_id", "text")


_NEAR = """t as (select min(doc_id) as id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as w from documents where text is not null group by text, w), s as (select distinct id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) as g from t where len(w) > 0),
n as (select id, count(*) as n from s group by id), c as (select a.id as id_a, b.id as id_b, count(*) as m from s a join s b on a.g = b.g and a.id < b.id group by all),
near as (select id_a, id_b, round(m / (x.n + y.n - m), 9) as jaccard from c join n x on x.id = id_a join n y on y.id = id_b where m / (x.n + y.n - m) >= 0.8)"""


@query(f"with {_NEAR} select * from near")
def near_duplicate_pairs(spark: SparkSession, d: str) -> DataFrame:
    return groups.near_duplicates(table(spark, d, "documents"), "doc_id", "text").withColumn("jaccard", F.round("jaccard", 9))


@query(f"""with recursive {_NEAR}, copies as (select doc_id as x, min(doc_id) over (partition by text) as y from documents where text is not null), one as (select id_a as x, id_b as y from near union select x, y from copies),
links as (select x, y from one union select y, x from one union select doc_id, doc_id from documents), reach as (select x, y from links union select reach.x, links.y from reach join links on reach.y = links.x) select x as id, min(y) as group_id from reach group by x""")
def duplicate_components(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    copies = groups.exact_duplicates(t, "doc_id", "text").select(F.col("id").alias("id_a"), F.col("class_id").alias("id_b"))
    edges = copies.unionByName(groups.near_duplicates(t, "doc_id", "text").select("id_a", "id_b"))
    return groups.components(t.select(F.col("doc_id").alias("id")), edges)


@query("select count(*) as n from documents d where not exists (select 1 from benchmark b where b.text = d.text) and text is not null")
def exclusion_anti(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").filter("text is not null")
    return t.join(table(spark, d, "benchmark").select("text"), "text", "left_anti").agg(F.count("*").alias("n"))


def _folds_sql(seed: int) -> str:
    h = f"('0x' || substr(md5('{seed}|' || group_id), 1, 8))::bigint"
    return f"select group_id, {seed} as seed, cast((row_number() over (partition by n_pos > 0 order by {h}, group_id) - 1) % 5 as int) as fold, n, n_pos from g"


@query(f"with {URLS}, g as (select host as group_id, count(*) as n, count(*) filter (label = 'phishing') as n_pos from u where host is not null group by host) " + " union all ".join(map(_folds_sql, (17, 42, 2026))))
def group_folds(spark: SparkSession, d: str) -> DataFrame:
    return groups.folds(url_records(spark, d).select("host", "label"), "host", F.col("label") == "phishing", 5, [17, 42, 2026])


@query(f"with {URLS} select host, count(distinct split) as roles from u group by host having count(distinct split) > 1")
def split_leak_check(spark: SparkSession, d: str) -> DataFrame:
    return groups.leak_check(url_records(spark, d).select("host", "split"), "host", "split")


@query("""with o as (select o_orderkey, o_custkey, cast(o_orderdate as date) as d from orders), c as (select d, sum(count(*)) over (order by d) as c, sum(count(*)) over () as t from o group by d),
q as (select min(d) filter (c >= 0.6 * t) as q0, min(d) filter (c >= 0.8 * t) as q1 from c), p as (select *, case when d <= q0 then 0 when d <= q1 then 1 else 2 end as r from o, q), f as (select *, min(r) over (partition by o_custkey) as f from p)
select o_orderkey, o_custkey, case r when 0 then 'train' when 1 then 'validation' else 'test' end as period, case when f < r then 'group_seen_earlier' end as dropped_reason from f""")
def temporal_split(spark: SparkSession, d: str) -> DataFrame:
    return groups.temporal(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderdate", "o_custkey").drop("o_orderdate")


@query(f"""with d as (select doc_id, {category_sql('source')} as source from documents), r as (select *, row_number() over (partition by source order by ('0x' || substr(md5('17|' || doc_id), 1, 8))::bigint, doc_id) as i, count(*) over (partition by source) as n from d)
select doc_id, source from r where i <= ceil(0.3 * n)""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return groups.stratified(table(spark, d, "documents").select("doc_id", category(F.col("source")).alias("source")), "doc_id", ["source"], 0.3, 17)


# Metrics


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_suppkey", "l_linestatus", F.floor(F.col("l_extendedprice") / 1000).cast("double").alias("score"), F.col("l_discount").alias("discount"), (F.col("l_returnflag") == "R").cast("int").alias("label"))


_S = "s as (select l_suppkey, l_linestatus, floor(l_extendedprice / 1000) as score, l_discount as discount, cast(l_returnflag = 'R' as int) as label from lineitem)"
_T = "t as (select score, sum(sum(label)) over w as tp, sum(sum(1 - label)) over w as fp, sum(label) as p, sum(sum(label)) over () as n_pos, sum(sum(1 - label)) over () as n_neg from s group by score window w as (order by score desc))"


def _at_sql(fpr: float) -> str:
    return f"""select {fpr} as target_fpr, b.score as threshold, b.tp as tp, b.fp as fp, n_pos, n_neg, case when b is null then 'no_feasible' end as undefined_reason
from (select max(case when fp <= n_neg * {fpr} and tp > 0 then struct_pack(tp := tp, score := score, fp := fp) end) as b, max(n_pos) as n_pos, max(n_neg) as n_neg from t)"""


@query(f"with {_S}, {_T} {_at_sql(0.01)} union all {_at_sql(0.05)}")
def threshold_at_fpr(spark: SparkSession, d: str) -> DataFrame:
    return metrics.thresholds(_scored(spark, d), [0.01, 0.05])


@query(f"with {_S.replace('floor(l_extendedprice / 1000) as score', 'l_discount as score')}, {_T} {_at_sql(0.01)} union all {_at_sql(0.05)}")
def threshold_undefined(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d).drop("score").withColumnRenamed("discount", "score")
    return metrics.thresholds(s, [0.01, 0.05])


_CELLS = "count(*) filter (label = 1 and score >= 90) as tp, count(*) filter (label = 1 and score < 90) as fn, count(*) filter (label = 0 and score >= 90) as fp, count(*) filter (label = 0 and score < 90) as tn"
_RATES = "round(tp / nullif(tp + fn, 0), 9) as recall, round(fp / nullif(fp + tn, 0), 9) as fpr, round(tp / nullif(tp + fp, 0), 9) as precision, round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) as f1, round((tp + fn) / nullif(tp + fn + fp + tn, 0), 9) as base_rate"


@query(f"with {_S}, c as (select l_linestatus, {_CELLS} from s group by all) select *, {_RATES} from c")
def confusion_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(_scored(spark, d), 90, ["l_linestatus"])


@query(f"with {_S}, c as (select 'all' as dim, null as value, {_CELLS} from s union all select 'l_linestatus', l_linestatus, {_CELLS} from s group by all union all select 'l_suppkey', cast(l_suppkey as varchar), {_CELLS} from s group by all) select *, {_RATES} from c")
def subgroup_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.subgroups(_scored(spark, d), 90, ["l_linestatus", "l_suppkey"])


@query(f"with {_S}, {_T} select round(sum(p / n_pos * tp / (tp + fp)), 9) as pr_auc from t")
def pr_auc(spark: SparkSession, d: str) -> DataFrame:
    return metrics.pr_auc(_scored(spark, d))


def _boot_sql(reps: int) -> str:
    cells = ", ".join(f"count(*) filter (label = {v} and score {op} {t}) as {n}_{k}" for n, t in (("M2", 95), ("M3", 90)) for k, v, op in (("tp", 1, ">="), ("fn", 1, "<"), ("fp", 0, ">="), ("tn", 0, "<")))
    sums = ", ".join(f"sum({n}_{k} * m) as {n}_{k}" for n in ("M2", "M3") for k in ("tp", "fn", "fp", "tn"))
    r, f = (lambda n: f"{n}_tp / nullif({n}_tp + {n}_fn, 0)"), (lambda n: f"{n}_fp / nullif({n}_fp + {n}_tn, 0)")
    made = [("recall", "M2", r("M2")), ("recall", "M3", r("M3")), ("fpr", "M2", f("M2")), ("fpr", "M3", f("M3")), ("recall_delta", "M3-M2", f"{r('M3')} - {r('M2')}"), ("fpr_delta", "M3-M2", f"{f('M3')} - {f('M2')}")]
    union = " union all ".join(f"select '{m}' as metric, '{c}' as config, {v} as v from per" for m, c, v in made)
    return f"""with {_S}, g as (select *, row_number() over (order by ('0x' || substr(md5(cast(l_suppkey as varchar)), 1, 8))::bigint, l_suppkey) - 1 as i from (select l_suppkey, {cells} from s group by l_suppkey)), n as (select count(*) as n from g),
draws as (select id // n as rep, ('0x' || substr(md5('17|' || id), 1, 8))::bigint % n as i from n, range(0, {reps} * (select n from n)) as x(id)), times as (select rep, i, count(*) as m from draws group by all),
per as (select rep, {sums} from times join g using (i) group by rep), v as ({union}) select metric, config, round(quantile_cont(v, 0.025), 9) as low, round(quantile_cont(v, 0.975), 9) as high, count(v) as n_valid, count(*) filter (v is null) as n_invalid from v group by all"""


@query(_boot_sql(2000))
def group_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return metrics.bootstrap(_scored(spark, d), "l_suppkey", {"M2": 95, "M3": 90}, 2000)


@query(f"""with {URLS}, p as (select record_id, max(tier) as a, max(case when label = 'benign' then 'gold' else 'bronze' end) as b from u where tier in ('gold', 'bronze') and label is not null group by record_id),
c as (select a, b, count(*) as n from p group by all), t as (select sum(n) as n, sum(case when a = b then n else 0 end) as same from c), x as (select a as v, sum(n) as na from c group by a), y as (select b as v, sum(n) as nb from c group by b),
e as (select sum(na * nb) as e from x join y using (v)) select cast(n as bigint) as n, round(same / n, 9) as p_o, round(e / (n * n), 9) as p_e, round((same / n - e / (n * n)) / (1 - e / (n * n)), 9) as kappa from t, e""")
def cohen_kappa(spark: SparkSession, d: str) -> DataFrame:
    u = url_records(spark, d).filter(F.col("tier").isin("gold", "bronze") & F.col("label").isNotNull())
    p = u.groupBy("record_id").agg(F.max("tier").alias("a"), F.max(F.when(F.col("label") == "benign", "gold").otherwise("bronze")).alias("b"))
    return metrics.kappa(p, "a", "b")


@query("select event_type, count(value) as n, round(quantile_cont(value, 0.5), 9) as p50, round(quantile_cont(value, 0.95), 9) as p95, count(*) filter (value > 400) as timeouts from events group by event_type")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return metrics.latency(table(spark, d, "events"), "value", ["event_type"], 400)


@query(f"with {URLS}, b as (select distinct host from u where label = 'benign' and host is not null) select count(distinct record_id) as phishing, count(distinct case when b.host is not null then record_id end) as covered, round(count(distinct case when b.host is not null then record_id end) / count(distinct record_id), 9) as coverage from u left join b on u.host = b.host where label = 'phishing'")
def coverage_rate(spark: SparkSession, d: str) -> DataFrame:
    """Phishing records on hosts that benign records are on too."""
    u = url_records(spark, d).select("record_id", "host", "label")
    b = u.filter("label = 'benign' and host is not null").select(F.col("host").alias("bh")).distinct()
    per = u.filter("label = 'phishing'").join(b, F.col("host") == F.col("bh"), "left").groupBy("record_id").agg(F.max(F.col("bh").isNotNull()).alias("c"))
    return per.agg(F.count("*").alias("phishing"), F.count_if("c").alias("covered")).withColumn("coverage", F.round(F.try_divide("covered", "phishing"), 9))


@query("""with q as (select date_trunc('quarter', o_orderdate) as q, o_custkey, sum(o_totalprice) as s from orders group by all), r as (select *, row_number() over (partition by q order by round(s, 2) desc, o_custkey) as r from q) select distinct o_custkey from r where r <= 10""")
def top_union_codes(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    q = table(spark, d, "orders").groupBy(F.date_trunc("quarter", "o_orderdate").alias("q"), "o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("s"))
    top = q.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("s"), "o_custkey"))).filter("r <= 10")
    return top.select("o_custkey").distinct()


# Streams, and their batch form

_BAD_URL = "url is null or not regexp_full_match(url, 'https?://[^\\s]+') or length(url) > 8192"
_REQUEST_ERROR = f"case when {_BAD_URL} then 'url' when html is null then 'html_missing' when html = '' then 'html' when length(html) > 1000000 then 'html_too_long' end"
_REQUEST_STATUS = f"case when {_BAD_URL} or html is null or html = '' or length(html) > 1000000 then 422 else 200 end"


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    phase = F.when(F.col("event_type") == "view", 0).otherwise(1)
    return table(spark, d, "events").select(F.col("user_id").alias("navigation_id"), F.col("event_id").alias("dom_revision"), phase.alias("phase"), F.col("ts").cast("timestamp").alias("ts"))


_N = "n as (select user_id as navigation_id, event_id as dom_revision, case when event_type = 'view' then 0 else 1 end as phase, ts from events)"


_LATEST = f"with {_N}, r as (select *, row_number() over (partition by navigation_id order by dom_revision desc, phase desc, ts desc) as r, count(*) over (partition by navigation_id) as received from n) select navigation_id, dom_revision, phase, ts, received from r where r = 1"


@query(_LATEST)
def latest_revision(spark: SparkSession, d: str) -> DataFrame:
    return navigation.latest(_snapshots(spark, d))


@query(_LATEST)
def stream_latest(spark: SparkSession, d: str) -> DataFrame:
    """The same from a stream: the snapshots are put into files by time, read file by file, and the updates merged."""
    at, rows = scratch_path(spark, "snapshots"), _snapshots(spark, d)
    rows.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(f"{at}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    updates = navigation.latest_stream(stream, "400 days")  # a replay: files may come in any order

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    updates.writeStream.outputMode("update").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return navigation.merge_updates(spark.read.schema(updates.schema).parquet(f"{at}/out/*"))


@query(f"""select {_REQUEST_ERROR} as error, {_REQUEST_STATUS} as status_code, count(*) as requests from (select distinct sha256, url, html from corpus) group by all""")
def stream_responses(spark: SparkSession, d: str) -> DataFrame:
    """A response for each of a stream of content requests, one made of every page, by error and status."""
    at = scratch_path(spark, "requests")
    table(spark, d, "corpus").select("sha256", "url", "html").distinct().select(request_body().alias("value")).repartition(3).write.text(f"{at}/in")
    got = navigation.responses(navigation.requests(spark, f"{at}/in"), ["v1"])
    got.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(got.schema).parquet(f"{at}/out").groupBy("error", "status_code").agg(F.count("*").alias("requests"))


@query("""with e as (select event_id, user_id, ts, value * 20 as ms, lead(ts) over (partition by user_id order by ts) as n from events)
select event_id, case when epoch_us(n) - epoch_us(ts) < least(coalesce(ms, 5000), 5000) * 1000 then 'superseded' when ms is null or ms > 5000 then 'unable_to_assess' else 'answered' end as outcome from e""")
def client_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return navigation.outcomes(table(spark, d, "events"), "user_id", "ts", F.col("value") * 20).select("event_id", "outcome")


@query(f"with {_N} select navigation_id, dom_revision, coalesce(max(dom_revision) over (partition by navigation_id order by ts, dom_revision rows between unbounded preceding and 1 preceding) >= dom_revision, false) as stale from n")
def stale_discard(spark: SparkSession, d: str) -> DataFrame:
    return navigation.stale_discard(_snapshots(spark, d)).select("navigation_id", "dom_revision", "stale")


@query("with e as (select event_id, user_id, ts, lead(ts) over (partition by user_id order by ts) as n from events) select event_id, user_id from e where n is null or epoch_us(n) - epoch_us(ts) > 3600 * 1000000::bigint")
def debounce(spark: SparkSession, d: str) -> DataFrame:
    return navigation.debounce(table(spark, d, "events"), "user_id", "ts", F.lit(3600)).select("event_id", "user_id")


@query("select event_type, time_bucket(interval 1 hour, ts) as window_start, count(*) as n from events group by all having count(*) > 5")
def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    return navigation.rate_limited(table(spark, d, "events"), "event_type", "ts", "1 hour", 5)


# Contracts and models


def request_body():
    """A content request of the columns sha256, url and html; nulls stay null in it."""
    uuid = F.regexp_replace(F.substring("sha256", 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    fields = {"request_id": uuid, "navigation_id": uuid, "dom_revision": F.lit(1), "phase": F.lit("url_content"), "url": F.col("url"), "preprocessing_version": F.lit("v1"), "capture_mode": F.lit("rendered_dom"), "html": F.col("html")}
    return F.to_json(F.struct(*(c.alias(k) for k, c in fields.items())), {"ignoreNullFields": "false"})


@query(f"select sha256, {_REQUEST_ERROR} as error, {_REQUEST_STATUS} as status_code from (select distinct sha256, url, html from corpus)")
def request_check(spark: SparkSession, d: str) -> DataFrame:
    """The first error of a content request made of every page, and its HTTP status."""
    c = table(spark, d, "corpus").select("sha256", "url", "html").distinct().select("sha256", contract.request_error(request_body()).alias("error"))
    return c.withColumn("status_code", contract.status_code(F.col("error")))


def _features(spark: SparkSession, d: str) -> DataFrame:
    """Of every document: text, label, fold by host, and signals of the organisations it names, of its domain and of what it asks for."""
    t = table(spark, d, "documents").filter("doc_id is not null")
    h = host(F.col("domain"))
    y = label_of(F.col("label"))
    named = matching.alias_matches(t, "doc_id", "text", table(spark, d, "dictionary")).groupBy(F.col("id").alias("named")).agg(F.count_distinct("org_id").cast("double").alias("orgs"), F.sum("occurrences").cast("double").alias("names"))
    got = t.select(
        "doc_id", "text", F.when(y == "phishing", 1).when(y == "benign", 0).cast("double").alias("label"), (metrics.hash32(F.lit(17), F.coalesce(h, F.col("doc_id").cast("string"))) % 3).cast("int").alias("fold"),
        F.coalesce(F.length(h), F.lit(0)).cast("double").alias("host_chars"), F.coalesce(F.regexp_count(h, F.lit("[0-9-]")), F.lit(0)).cast("double").alias("host_marks"), F.coalesce(F.size(F.split(h, "\\.")), F.lit(0)).cast("double").alias("host_labels"),
        requests(F.col("text")).cast("double").alias("asks"), F.size(claims(F.col("text"))).cast("double").alias("claims"),
    ).join(named, F.col("doc_id") == F.col("named"), "left").drop("named")
    return write_table(got.fillna(0.0, ["orgs", "names"]), "features")


SIGNALS = {"org": ["orgs", "names"], "domain": ["host_chars", "host_marks", "host_labels"], "intent": ["asks", "claims"]}


@query()
def lr_scores(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-fold scores of words and all signals; folds keep hosts together."""
    return models.out_of_fold(_features(spark, d), "doc_id", "fold", 3, "text", [x for s in SIGNALS.values() for x in s])


@query()
def ablation(spark: SparkSession, d: str) -> DataFrame:
    """Average precision of out-of-fold scores of all signals, and with the organisation, the domain and the intent left out in
    turn, on the same folds of the same documents."""
    f, got = _features(spark, d), None
    for left_out in (None, *SIGNALS):
        numbers = [x for s, xs in SIGNALS.items() if s != left_out for x in xs]
        some = metrics.pr_auc(models.out_of_fold(f, "doc_id", "fold", 3, None, numbers)).select(F.lit(f"without_{left_out}" if left_out else "all").alias("config"), "pr_auc")
        got = some if got is None else got.unionByName(some)
    return got


@query()
def latent_scores(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-fold scores of words reduced to sixteen directions, which are fitted on the training rows of the fold only."""
    return models.out_of_fold(_features(spark, d), "doc_id", "fold", 3, "text", SIGNALS["domain"], directions=16)


@query(f"""with m as (select doc_id, {host_sql('domain')} as host, {label_sql('label')} as label, text from documents), own as (select distinct host from m where label = 'benign' and host is not null)
select doc_id, cast(coalesce(regexp_matches(lower(text), '{CLAIMS_ANY}'), false) and host is not null and host not in (select host from own) and coalesce(regexp_matches(lower(text), '{REQUESTS}'), false) as int) as score from m""")
def b_rule(spark: SparkSession, d: str) -> DataFrame:
    """The rule baseline: a claim is made, on a host no benign document is on, and something is asked for that must not be given."""
    t = table(spark, d, "documents").select("doc_id", host(F.col("domain")).alias("host"), label_of(F.col("label")).alias("label"), "text")
    own = t.filter("label = 'benign' and host is not null").select(F.col("host").alias("own")).distinct()
    got = t.join(own, F.col("host") == F.col("own"), "left")
    return got.select("doc_id", models.rule_score(F.size(claims(F.col("text"))) > 0, F.col("host").isNotNull() & F.col("own").isNull(), requests(F.col("text"))).alias("score"))
