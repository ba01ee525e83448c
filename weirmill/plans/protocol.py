"""Queries of the study's protocol over the project's tables: selection, eligibility, joins of the index, relations of hosts
and organisations, quality control, analyses. Each stands beside the SQL it is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirmill.functions import html
from weirmill.functions.hosts import host, with_registrable
from weirmill.functions.text import category, char_ngrams, claims, requests
from weirmill.functions.text import label as label_of
from weirmill.operators import audit, contract, groups, matching, metrics, service
from weirmill.plans.core import _NEAR, _PSL, _S, _scored, query
from weirmill.plans.sql import URLS
from weirmill.plans.sql import category as category_sql
from weirmill.plans.sql import host as host_sql
from weirmill.plans.sql import label as label_sql
from weirmill.plans.tables import table, url_records, url_values
from weirmill.session import checked_broadcast, write_table

_ORG = "om as (select name, min(org_id) as org_id from (select org_id, lower(unnest(list_concat([display_name], aliases, service_names))) as name from dictionary) group by name)"
_PAGES = f"""pg0 as (select distinct sha256, url, {label_sql('label')} as label, {category_sql('lang')} as lang, {host_sql('url')} as host, lower(trim(target)) as target from corpus),
h as (select distinct host from pg0 where host is not null), {_PSL}, {_ORG},
pg as (select sha256, url, label, lang, pg0.host, registrable, target, org_id from pg0 left join r on pg0.host = r.host left join om on target = name)"""


def organisations(spark: SparkSession, d: str) -> DataFrame:
    """``(name, org_id)``: every name of the dictionary in lower case."""
    dic = table(spark, d, "dictionary")
    names = F.concat(F.array("display_name"), F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("service_names", F.array().cast("array<string>")))
    return dic.select("org_id", F.explode(names).alias("n")).groupBy(F.lower("n").alias("name")).agg(F.min("org_id").alias("org_id"))


def pages(spark: SparkSession, d: str) -> DataFrame:
    """Distinct pages with label, host, registrable domain and, where the dictionary knows the target, its organisation."""
    c = table(spark, d, "corpus").select("sha256", "url", label_of(F.col("label")).alias("label"), category(F.col("lang")).alias("lang"), host(F.col("url")).alias("host"), F.lower(F.trim("target")).alias("target")).distinct()
    c = with_registrable(c, "host", table(spark, d, "psl"))
    return c.join(checked_broadcast(organisations(spark, d)), F.col("target") == F.col("name"), "left").drop("name")


# Selection and eligibility


@query("select row_idx, label, html_chars from pilot_profile order by row_idx limit 20")
def first_rows(spark: SparkSession, d: str) -> DataFrame:
    return audit.first_rows(table(spark, d, "pilot_profile").select("row_idx", "label", "html_chars"), ["row_idx"], 20)


@query(f"select case when {category_sql('lang')} = 'en' then 'main' else coalesce({category_sql('lang')}, 'unknown') end as subset, count(*) as n, count(*) filter (text is null or text = '') as without_text from documents group by 1")
def language_sets(spark: SparkSession, d: str) -> DataFrame:
    """The main set is English; every other language is kept as a subgroup of its own."""
    lang = category(F.col("lang"))
    t = table(spark, d, "documents").select(F.when(lang == "en", "main").otherwise(F.coalesce(lang, F.lit("unknown"))).alias("subset"), "text")
    return t.groupBy("subset").agg(F.count("*").alias("n"), F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("without_text"))


@query(f"""with c as (select {label_sql('label')} as label, {host_sql('domain')} is not null and coalesce(text, '') <> '' and {label_sql('label')} is not null as complete from documents)
select label, count(*) as n, count(*) filter (complete) as complete from c group by label""")
def complete_cases(spark: SparkSession, d: str) -> DataFrame:
    """Documents all configurations can score: with a host, a text and a label. Chosen once, before any configuration."""
    y = label_of(F.col("label"))
    whole = host(F.col("domain")).isNotNull() & (F.coalesce("text", F.lit("")) != "") & y.isNotNull()
    return table(spark, d, "documents").select(y.alias("label"), whole.alias("complete")).groupBy("label").agg(F.count("*").alias("n"), F.count_if("complete").alias("complete"))


@query(f"""with {URLS}, v as (select distinct host from u where tier = 'gold' and host is not null), e as (select record_id, max(tier in ('gold', 'silver')) as tiered, max(v.host is not null) as verified from u left join v on u.host = v.host group by record_id)
select coalesce(tiered, false) as tiered, verified, coalesce(tiered, false) or verified as eligible, count(*) as records from e group by all""")
def eligible_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Records of the gold and silver tier are eligible, others only where their host is verified by a gold record."""
    u = url_records(spark, d).select("record_id", "tier", "host")
    v = u.filter("tier = 'gold' and host is not null").select(F.col("host").alias("vh")).distinct()
    got = u.join(v, F.col("host") == F.col("vh"), "left").groupBy("record_id").agg(F.max(F.col("tier").isin("gold", "silver")).alias("tiered"), F.max(F.col("vh").isNotNull()).alias("verified"))
    tiered = F.coalesce("tiered", F.lit(False))
    return got.select(tiered.alias("tiered"), "verified", (tiered | F.col("verified")).alias("eligible")).groupBy("tiered", "verified", "eligible").agg(F.count("*").alias("records"))


@query(f"""with {URLS}, s as (select coalesce(source, 'none') || '/' || coalesce(scenario, 'none') as feed, count(*) filter (label = 'phishing') as n_pos, count(*) filter (label = 'benign') as n_neg from u group by 1)
select *, case when n_pos > 0 and n_neg > 0 then 'pooled' when n_neg > 0 then 'challenge' when n_pos > 0 then 'one_class' end as role from s""")
def challenge_sources(spark: SparkSession, d: str) -> DataFrame:
    """Feeds of benign records only are a challenge set of their own, never pooled."""
    y = F.when(F.col("label") == "phishing", 1).when(F.col("label") == "benign", 0)
    feed = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("scenario", F.lit("none")))
    return groups.source_roles(url_values(spark, d).select(feed.alias("feed"), y.alias("y")), "feed", "y")


@query("""with s as (select label, case when text_chars > 0 then password_inputs + forms end as score from pilot_profile)
select label, count(*) filter (score >= 2) as warning, count(*) filter (score < 2) as no_indication, count(*) filter (score is null) as unable_to_assess from s group by label""")
def verdict_counts(spark: SparkSession, d: str) -> DataFrame:
    """Pages without text can't be assessed: they are no negatives."""
    s = table(spark, d, "pilot_profile").select("label", F.when(F.col("text_chars") > 0, F.col("password_inputs") + F.col("forms")).alias("score"))
    return metrics.verdict_counts(s, 2, ["label"])


@query(f"""with k as (select sha256, {category_sql('lang')} as lang, url, min(coalesce(cast(try_cast(case when regexp_matches(date, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') then date end as date) as varchar), '9999')) as day from corpus group by all),
s as (select distinct url from k where day < '2025-06-01'), f as (select * from k where day >= '2025-06-01')
select sha256, url from f where url is not null and url not in (select url from s where url is not null)""")
def feed_unseen(spark: SparkSession, d: str) -> DataFrame:
    """Pages of the later feed whose address no earlier delivery had."""
    day = F.when(F.col("date").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date("date", "yyyy-MM-dd").cast("string"))
    k = table(spark, d, "corpus").groupBy("sha256", category(F.col("lang")).alias("lang"), "url").agg(F.min(F.coalesce(day, F.lit("9999"))).alias("day"))
    feed = k.filter("day >= '2025-06-01' and url is not null")
    return groups.without(feed, k.filter("day < '2025-06-01'"), ["url"]).select("sha256", "url")


# Joins of the index


@query(f"""with l as (select sha256, max({label_sql('label')}) as label from corpus group by sha256)
select source_split, source_id, capture_mode, l.label, count(*) as samples, count(distinct group_id) as group_count from sample_index s join l on s.sha256 = l.sha256 group by all""")
def index_joined(spark: SparkSession, d: str) -> DataFrame:
    """The index with the labels of its pages and the splits of its groups: distribution over source, capture and class."""
    labels = table(spark, d, "corpus").groupBy("sha256").agg(F.max(label_of(F.col("label"))).alias("label"))
    s = table(spark, d, "sample_index").join(labels, "sha256")
    return s.groupBy("source_split", "source_id", "capture_mode", "label").agg(F.count("*").alias("samples"), F.count_distinct("group_id").alias("group_count"))


@query(f"""with l as (select sha256, max({label_sql('label')}) as verified_label from corpus where target is not null group by sha256)
select sample_id, {label_sql('source_label')} as source_label, verified_label from sample_index s left join l on s.sha256 = l.sha256""")
def labels_side_by_side(spark: SparkSession, d: str) -> DataFrame:
    """The source's label beside that of pages whose target was named; null where none was."""
    l_ = table(spark, d, "corpus").filter("target is not null").groupBy("sha256").agg(F.max(label_of(F.col("label"))).alias("verified_label"))
    return table(spark, d, "sample_index").join(l_, "sha256", "left").select("sample_id", label_of(F.col("source_label")).alias("source_label"), "verified_label")


@query("""with x as (select * from sample_index where exclusion_reason is not null) select sample_id, source_split from sample_index
where sample_id not in (select sample_id from x) and (sha256 is null or sha256 not in (select sha256 from x where sha256 is not null)) and (group_id is null or group_id not in (select group_id from x where group_id is not null))""")
def registry_exclusion(spark: SparkSession, d: str) -> DataFrame:
    """Samples that share neither id, content nor group with an excluded one."""
    s = table(spark, d, "sample_index")
    return groups.without(s, s.filter("exclusion_reason is not null"), ["sample_id", "sha256", "group_id"]).select("sample_id", "source_split")


@query(f"""with {URLS}, h as (select distinct host from u where host is not null), {_PSL}, g as (select record_id, split, coalesce(registrable, u.host) as g from u left join r on u.host = r.host),
seen as (select distinct g from g where split in ('train', 'val') and g is not null) select record_id, min(g) as group_id from g where split = 'test' and (g is null or g not in (select g from seen)) group by record_id""")
def official_test(spark: SparkSession, d: str) -> DataFrame:
    """Test records whose registrable domain no record of the development splits has."""
    u = with_registrable(url_records(spark, d).select("record_id", "split", "host"), "host", table(spark, d, "psl")).select("record_id", "split", F.coalesce("registrable", "host").alias("g"))
    u = write_table(u, "grouped")
    kept = groups.without(u.filter("split = 'test'"), u.filter(F.col("split").isin("train", "val")), ["g"])
    return kept.groupBy("record_id").agg(F.min("g").alias("group_id"))


@query(f"with t as (select sha256(text) as sha256, {category_sql('source')} as source, doc_id from documents where text is not null) select sha256, count(distinct source) as sources, count(doc_id) as rows from t where source is not null group by sha256 having count(distinct source) > 1")
def cross_source_duplicates(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").filter("text is not null").select(F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), category(F.col("source")).alias("source"), "doc_id")
    return groups.in_several(t.filter("source is not null"), "sha256", "source", "doc_id")


@query(f"select coalesce({category_sql('source')}, 'none') as source_id, 'main' as part, count(*) as n from documents group by 1 union all select {category_sql('source')}, 'supplement', count(*) from benchmark group by 1")
def union_by_source(spark: SparkSession, d: str) -> DataFrame:
    """The main and the supplementary collection, together but reported apart."""
    main = table(spark, d, "documents").select(F.coalesce(category(F.col("source")), F.lit("none")).alias("source_id"), F.lit("main").alias("part"))
    more = table(spark, d, "benchmark").select(category(F.col("source")).alias("source_id"), F.lit("supplement").alias("part"))
    return main.unionByName(more).groupBy("source_id", "part").agg(F.count("*").alias("n"))


# Organisations and hosts

_FIRST = "fp as (select registrable as hostname, min(org_id) as org_id from pg where org_id is not null and registrable is not null group by registrable), sh as (select distinct suffix from psl where section = 'private' and kind = 'rule')"


def rules(spark: SparkSession, d: str, p: DataFrame) -> DataFrame:
    """``(org_id, hostname, role)``, as far as the tables hold evidence: a registrable domain serves the first organisation its
    pages name, hosts under a private suffix belong to whoever uses them."""
    first = p.filter("org_id is not null and registrable is not null").groupBy(F.col("registrable").alias("hostname")).agg(F.min("org_id").alias("org_id"))
    shared = table(spark, d, "psl").filter("section = 'private' and kind = 'rule'").select(F.lit(None).cast("string").alias("org_id"), F.lower("suffix").alias("hostname"), F.lit("user_content_hosting").alias("role")).distinct()
    return first.select("org_id", "hostname", F.lit("authorized_service").alias("role")).unionByName(shared)


@query(f"""with {_PAGES}, {_FIRST}, x as (select sha256, url, pg.host, pg.org_id, exists (select 1 from sh where ends_with(pg.host, '.' || suffix)) as shared, fp.org_id as rule_org from pg left join fp on registrable = hostname)
select sha256, url, host, org_id, case when org_id is null then 'not_applicable' when shared then 'unverified_shared_hosting' when rule_org = org_id then 'verified_authorized' when rule_org is not null then 'mismatch' else 'unverified' end as domain_relation from x""")
def domain_relation(spark: SparkSession, d: str) -> DataFrame:
    """The relation of every page's host with the organisation its target names. Shared hosting is never a verified match."""
    p = write_table(pages(spark, d), "pages")
    r = rules(spark, d, p)
    own = matching.boundary_matches(p, "host", r.filter("role <> 'user_content_hosting'")).select(F.col("host").alias("h1"), F.col("org_id").alias("rule_org"), F.col("role").alias("own_role"))
    shared = matching.boundary_matches(p, "host", r.filter("role = 'user_content_hosting'")).filter("host <> rule_host").select(F.col("host").alias("h2"), F.col("role").alias("shared_role"))
    got = p.join(own, F.col("host") == F.col("h1"), "left").join(shared, F.col("host") == F.col("h2"), "left")
    return got.select("sha256", "url", "host", "org_id", matching.relation(F.col("org_id"), F.coalesce("shared_role", "own_role"), F.col("rule_org")).alias("domain_relation"))


_PATH = "regexp_extract(regexp_replace(url, '^([A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*|^[^/?#]*', ''), '^[^?#]*')"


@query(f"""with {_PAGES}, w as (select host, coalesce(nullif({_PATH}, ''), '/') as path, label, org_id from pg where host is not null), q as (select distinct host as hostname, rtrim(regexp_extract(path, '^/[^/]*'), '/') as path_prefix, 'first_party_content' as role, org_id from w where org_id is not null),
best as (select w.host, w.path, hostname as rule_host, path_prefix, role, q.org_id, row_number() over (partition by w.host, w.path order by length(hostname) desc, length(path_prefix) desc, path_prefix desc, role desc, q.org_id desc) as i
  from (select distinct host, path from w) w join q on (w.host = hostname or ends_with(w.host, '.' || hostname)) and (path_prefix = '' or w.path = path_prefix or starts_with(w.path, path_prefix || '/'))) select host, path, rule_host, path_prefix, role, org_id from best where i = 1""")
def scope_match(spark: SparkSession, d: str) -> DataFrame:
    """Pages under the host and first path segment of a page that names an organisation."""
    p = pages(spark, d)
    path = F.regexp_extract(F.regexp_replace("url", "^([A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*|^[^/?#]*", ""), "^[^?#]*", 0)
    p = write_table(p.filter("host is not null").withColumn("path", F.coalesce(F.nullif(path, F.lit("")), F.lit("/"))), "paths")
    r = p.filter("org_id is not null").select("org_id", F.col("host").alias("hostname"), F.regexp_extract("path", "^/[^/]*", 0).alias("path_prefix"), F.lit("first_party_content").alias("role")).distinct()
    return matching.scope_matches(p, "host", F.col("path"), r)


@query(f"""with {URLS}, h as (select distinct host from u where host is not null), {_PSL}, sh as (select distinct suffix from psl where section = 'private' and kind = 'rule')
select h.host, coalesce(registrable, h.host) as tenant, exists (select 1 from sh where ends_with(h.host, '.' || suffix)) as shared_hosting, registrable is not null as boundary_known from h left join r on h.host = r.host""")
def tenant_groups(spark: SparkSession, d: str) -> DataFrame:
    """The tenant of every host: below a private suffix the label before it, where no boundary is known the whole host."""
    psl = table(spark, d, "psl")
    h = with_registrable(url_records(spark, d).select("host").filter("host is not null").distinct(), "host", psl)
    shared = psl.filter("section = 'private' and kind = 'rule'").select(F.lower("suffix").alias("hostname"), F.lit("s").alias("org_id"), F.lit("user_content_hosting").alias("role")).distinct()
    m = matching.boundary_matches(h, "host", shared).filter("host <> rule_host").select(F.col("host").alias("h2"))
    return h.join(m, F.col("host") == F.col("h2"), "left").select("host", F.coalesce("registrable", "host").alias("tenant"), F.col("h2").isNotNull().alias("shared_hosting"), F.col("registrable").isNotNull().alias("boundary_known"))


@query(r"""with a as (select org_id, lower(unnest(list_concat([display_name], aliases, service_names))) as token from dictionary), t as (select distinct sha256, unnest(regexp_split_to_array(lower(url), '[^\p{L}\p{N}]+')) as token from corpus where url is not null)
select distinct sha256, org_id from t join a using (token) where regexp_full_match(token, '[\p{L}\p{N}]+')""")
def names_in_url(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "corpus").select("sha256", "url").distinct()
    return matching.names_in_url(c, "sha256", "url", table(spark, d, "dictionary")).select(F.col("id").alias("sha256"), "org_id")


@query(f"""with {_PAGES} select case when org_id is not null then 'in' when target is null then 'unknown' else 'out' end as dictionary, count(distinct sha256) as pages, count(distinct coalesce(registrable, host)) as domains,
round(count(distinct sha256) / (select count(distinct sha256) from pg where label = 'phishing'), 9) as share from pg where label = 'phishing' group by 1""")
def dictionary_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Phishing pages and domains whose target the dictionary has, does not have, or that name none."""
    p = pages(spark, d).filter("label = 'phishing'")
    state = F.when(F.col("org_id").isNotNull(), "in").when(F.col("target").isNull(), "unknown").otherwise("out")
    total = p.agg(F.count_distinct("sha256").alias("n")).first()["n"]
    per = p.groupBy(state.alias("dictionary")).agg(F.count_distinct("sha256").alias("pages"), F.count_distinct(F.coalesce("registrable", "host")).alias("domains"))
    return per.withColumn("share", F.round(F.try_divide("pages", F.lit(total)), 9))


@query(f"with {_PAGES} select org_id, count(distinct sha256) as pages, count(distinct coalesce(registrable, host)) as domains from pg where label = 'phishing' and org_id is not null group by org_id having count(distinct coalesce(registrable, host)) >= 5")
def reported_organisations(spark: SparkSession, d: str) -> DataFrame:
    """Organisations with at least five independent phishing domains."""
    p = pages(spark, d).filter("label = 'phishing' and org_id is not null")
    return p.groupBy("org_id").agg(F.count_distinct("sha256").alias("pages"), F.count_distinct(F.coalesce("registrable", "host")).alias("domains")).filter("domains >= 5")


@query(f"""with {URLS.replace(" as label,", f" as label, {category_sql('lang')} as lang,", 1)}, h as (select distinct host from u where host is not null), {_PSL} select lang, count(distinct record_id) as phishing, count(distinct coalesce(registrable, u.host)) as domains, count(distinct record_id) >= 150 and count(distinct coalesce(registrable, u.host)) >= 50 as more_than_descriptive
from u left join r on u.host = r.host where label = 'phishing' group by lang""")
def regional_gate(spark: SparkSession, d: str) -> DataFrame:
    """Phishing records and domains of each language, and whether they are enough for more than description."""
    u = with_registrable(url_records(spark, d).filter("label = 'phishing'").select("record_id", "lang", "host"), "host", table(spark, d, "psl"))
    per = u.groupBy("lang").agg(F.count_distinct("record_id").alias("phishing"), F.count_distinct(F.coalesce("registrable", "host")).alias("domains"))
    return per.withColumn("more_than_descriptive", audit.enough(F.col("phishing"), F.col("domains")))


# Quality control


_QC = ["class", "language", "source", "mode", "emptiness", "date_status", "duplicate"]


@query(f"""with s as (select {label_sql('source_label')} as class, {category_sql('language')} as language, source_id as source, capture_mode as mode, case when html_chars > 0 then 'filled' else 'empty' end as emptiness, date_status, case when count(*) over (partition by s.sha256) > 1 then 'repeated' else 'single' end as duplicate,
  exclusion_reason is null and date_status = 'valid' as kept from sample_index s left join pilot_profile p on s.sha256 = p.sha256) """ + " union all ".join(f"select '{c}' as dim, {c} as value, count(*) as before, count(*) filter (kept) as after from s group by {c}" for c in _QC))
def qc_before_after(spark: SparkSession, d: str) -> DataFrame:
    """Samples before and after the filter, by class, language, source, capture mode, emptiness, date and repetition."""
    s = table(spark, d, "sample_index").join(table(spark, d, "pilot_profile").select("sha256", "html_chars"), "sha256", "left")
    n = s.groupBy(F.col("sha256").alias("h")).agg(F.count("*").alias("n"))
    s = s.join(n, F.col("sha256").eqNullSafe(F.col("h")), "left")
    kept = F.col("exclusion_reason").isNull() & (F.col("date_status") == "valid")
    cols = {"class": label_of(F.col("source_label")), "language": category(F.col("language")), "source": F.col("source_id"), "mode": F.col("capture_mode"), "emptiness": F.when(F.col("html_chars") > 0, "filled").otherwise("empty"), "date_status": F.col("date_status"), "duplicate": F.when(F.col("n") > 1, "repeated").otherwise("single")}
    return audit.before_after(s.select(*(c.alias(k) for k, c in cols.items()), kept.alias("kept")), _QC, F.col("kept"))


@query("""with p as (select source_id, capture_mode, exclusion_reason is not null or date_status <> 'valid' as bad from sample_index), g as (select source_id, capture_mode, count(*) as rows, count(*) filter (bad) as problems from p group by all)
select *, case when problems / rows > 0.5 then 'drop' when problems / rows > 0.1 then 'enlarge' else 'keep' end as action from g""")
def strata_escalation(spark: SparkSession, d: str) -> DataFrame:
    """Strata of source and capture whose evidence has problems: enlarged above a tenth, dropped above a half."""
    return audit.strata_with_problems(table(spark, d, "sample_index"), ["source_id", "capture_mode"], F.col("exclusion_reason").isNotNull() | (F.col("date_status") != "valid"), 0.1, 0.5)


@query(f"""with {URLS}, o as (select record_id, source, cast(date_trunc('month', day) as date) as month, label, tier, row_number() over (partition by record_id order by ingested_at nulls first, source nulls first, label nulls first, tier nulls first, day nulls first) as k from u where record_id is not null),
r as (select *, row_number() over (partition by source, month, label, tier order by ('0x' || substr(md5('42|' || record_id), 1, 8))::bigint, record_id) as i, count(*) over (partition by source, month, label, tier) as n from o where k = 1) select record_id, source, month, label, tier from r where i <= ceil(0.05 * n)""")
def planned_sample(spark: SparkSession, d: str) -> DataFrame:
    """A twentieth of the records of every source, month, class and tier, by rule and never by a model's result."""
    first = F.min(F.struct("ingested_at", "source", "label", "tier", "day")).alias("f")
    u = url_values(spark, d).filter("record_id is not null").groupBy("record_id").agg(first).select("record_id", "f.source", F.trunc("f.day", "month").alias("month"), "f.label", "f.tier")
    return groups.stratified(u, "record_id", ["source", "month", "label", "tier"], 0.05, 42)


@query("""select event_type, count(value) as timed, round(avg(value), 6) as mean_seconds, round(sum(value) / 3600, 6) as total_hours, case when avg(value) > 300 then 1200 else 2000 end as target from events group by event_type""")
def annotation_effort(spark: SparkSession, d: str) -> DataFrame:
    return metrics.effort(table(spark, d, "events"), "value", ["event_type"], 300, 2000, 1200)


@query(f"""with o as (select record_id, {label_sql('label')} as label, row_number() over (partition by record_id order by ingested_at desc, {label_sql('label')} desc nulls last) as i, count(*) over (partition by record_id) as passes from url_audit where record_id is not null)
select record_id, label as final_label, passes from o where i = 1""")
def final_labels(spark: SparkSession, d: str) -> DataFrame:
    """The last delivery of each record; the earlier ones stay where they are. By aggregation, without a sort of the passes."""
    u = table(spark, d, "url_audit").filter("record_id is not null").select("record_id", "ingested_at", label_of(F.col("label")).alias("label"))
    return u.groupBy("record_id").agg(F.max(F.struct("ingested_at", "label")).alias("m"), F.count("*").alias("passes")).select("record_id", F.col("m.label").alias("final_label"), "passes")


@query(f"""with l as (select sha256, max({label_sql('label')}) as b from corpus group by sha256), p as (select sample_id, {label_sql('source_label')} as a, b, s.source_id from sample_index s join l on s.sha256 = l.sha256),
z as (select *, row_number() over (partition by source_id order by ('0x' || substr(md5('7|' || sample_id), 1, 8))::bigint, sample_id) as i, count(*) over (partition by source_id) as n from p), p2 as (select a, b from z where i <= ceil(0.3 * n) and a is not null and b is not null),
c as (select a, b, count(*) as n from p2 group by all), t as (select sum(n) as n, sum(case when a = b then n else 0 end) as same from c), x as (select a as v, sum(n) as na from c group by a), y as (select b as v, sum(n) as nb from c group by b), e as (select sum(na * nb) as e from x join y using (v))
select cast(n as bigint) as n, round(same / n, 9) as p_o, round(e / (n * n), 9) as p_e, round(case when e / (n * n) < 1 then (same / n - e / (n * n)) / (1 - e / (n * n)) end, 9) as kappa from t, e""")
def pass_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of the source's label and the page's on a random subset: three tenths of each source."""
    l_ = table(spark, d, "corpus").groupBy("sha256").agg(F.max(label_of(F.col("label"))).alias("b"))
    p = table(spark, d, "sample_index").join(l_, "sha256").select("sample_id", "source_id", label_of(F.col("source_label")).alias("a"), "b")
    return metrics.kappa(groups.stratified(p, "sample_id", ["source_id"], 0.3, 7), "a", "b")


# Folds and analyses


@query(f"""with {URLS}, f as (select source, label, ('0x' || substr(md5('17|' || host), 1, 8))::bigint % 5 as fold from u where host is not null and source is not null),
g as (select source, fold, max(coalesce(label = 'phishing', false)) as p, max(coalesce(label = 'benign', false)) as n from f group by all) select source from g group by source having count(*) filter (p and n) = 5""")
def pooled_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources with both classes in every fold; only these take part in the pooled run."""
    y = F.when(F.col("label") == "phishing", 1).when(F.col("label") == "benign", 0)
    u = url_records(spark, d).filter("host is not null and source is not null").select("source", (metrics.hash32(F.lit(17), "host") % 5).alias("fold"), y.alias("y"))
    return groups.sources_of_all_folds(u, "source", "fold", "y", 5)


@query(f"""with {URLS}, g as (select host, count(distinct record_id) as records from u where host is not null group by host)
select ('0x' || substr(md5('outer42|' || host), 1, 8))::bigint % 5 as outer_fold, ('0x' || substr(md5('inner42|' || host), 1, 8))::bigint % 3 as inner_fold, count(*) as hosts, sum(records) as records from g group by all""")
def nested_folds(spark: SparkSession, d: str) -> DataFrame:
    """Hosts and records of the inner folds within each outer fold's rest."""
    per = url_records(spark, d).filter("host is not null").groupBy("host").agg(F.count_distinct("record_id").alias("records"))
    return groups.nested_folds(per, "host", 5, 3, 42).groupBy("outer_fold", "inner_fold").agg(F.count("*").alias("hosts"), F.sum("records").alias("records"))


_FOLD = "('0x' || substr(md5(seed || '|' || l_suppkey), 1, 8))::bigint % 5"


@query(f"""with {_S}, m as (select seed, {_FOLD} as fold, count(*) filter (label = 1 and score >= 90) / nullif(count(*) filter (label = 1), 0) as recall from s, (values (17), (42), (2026)) as x(seed) group by all), p as (select seed, avg(recall) as a from m group by seed)
select 'M3' as config, count(recall) as runs, round(avg(recall), 9) as mean, round(stddev_samp(recall), 6) as sd_runs, (select round(stddev_samp(a), 6) from p) as sd_seeds from m""")
def fold_dispersion(spark: SparkSession, d: str) -> DataFrame:
    """Spread of recall over five folds of three seeds; groups stay in one fold, and a row is counted per group first."""
    s = _scored(spark, d).groupBy("l_suppkey").agg(F.count_if((F.col("label") == 1) & (F.col("score") >= 90)).alias("tp"), F.count_if(F.col("label") == 1).alias("pos"))
    runs = s.withColumn("seed", F.explode(F.array(F.lit(17), F.lit(42), F.lit(2026)))).groupBy("seed", (metrics.hash32("seed", "l_suppkey") % 5).alias("fold")).agg(F.try_divide(F.sum("tp"), F.sum("pos")).alias("recall"))
    return metrics.dispersion(runs.withColumn("config", F.lit("M3")), "recall", "seed", ["config"])


@query(f"""with {_PAGES}, t as (select pg.sha256, max(pg.label) as label, max(org_id is not null) as known, max(forms + password_inputs) as score from pg join pilot_profile p on pg.sha256 = p.sha256 where p.text_chars > 0 group by pg.sha256),
a as (select 'A' as analysis, * from t union all select 'B', * from t where known), c as (select analysis, count(*) filter (label = 'phishing' and score >= 2) as tp, count(*) filter (label = 'phishing' and score < 2) as fn, count(*) filter (label = 'benign' and score >= 2) as fp, count(*) filter (label = 'benign' and score < 2) as tn from a group by analysis)
select *, round(tp / nullif(tp + fn, 0), 9) as recall, round(fp / nullif(fp + tn, 0), 9) as fpr, round(tp / nullif(tp + fp, 0), 9) as precision, round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) as f1, round((tp + fn) / nullif(tp + fn + fp + tn, 0), 9) as base_rate from c""")
def analysis_a_b(spark: SparkSession, d: str) -> DataFrame:
    """One table of scores under one threshold, over all pages (A) and over those whose organisation the dictionary has (B)."""
    s = table(spark, d, "pilot_profile").filter("text_chars > 0").select(F.col("sha256").alias("h"), (F.col("forms") + F.col("password_inputs")).alias("score"))
    p = pages(spark, d).join(s, F.col("sha256") == F.col("h")).groupBy("sha256").agg(F.max("label").alias("y"), F.max(F.col("org_id").isNotNull()).alias("known"), F.max("score").alias("score"))
    p = p.withColumn("label", F.when(F.col("y") == "phishing", 1).when(F.col("y") == "benign", 0))
    both = p.withColumn("analysis", F.explode(F.when(F.col("known"), F.array(F.lit("A"), F.lit("B"))).otherwise(F.array(F.lit("A")))))
    return metrics.confusion(both, 2, ["analysis"])


@query(f"""with {_PAGES}, q as (select org_id, date_trunc('quarter', cast(s.collected_at as date)) as q, count(distinct pg.sha256) as n from pg join sample_index s on pg.sha256 = s.sha256 where org_id is not null and s.collected_at is not null group by all),
top as (select *, row_number() over (partition by q order by n desc, org_id) as i from q) select org_id, count(*) as quarters from top where i <= 10 group by org_id""")
def top_organisations(spark: SparkSession, d: str) -> DataFrame:
    """Union of the ten most frequent targets of each quarter, spellings brought to one organisation first."""
    from pyspark.sql import Window as W

    s = table(spark, d, "sample_index").filter("collected_at is not null").select("sha256", F.date_trunc("quarter", "collected_at").alias("q")).distinct()
    n = pages(spark, d).filter("org_id is not null").join(s, "sha256").groupBy("org_id", "q").agg(F.count_distinct("sha256").alias("n"))
    top = n.withColumn("i", F.row_number().over(W.partitionBy("q").orderBy(F.desc("n"), "org_id"))).filter("i <= 10")  # a row an organisation and quarter
    return top.groupBy("org_id").agg(F.count("*").alias("quarters"))


# Texts and pages


@query("""with t as (select lower(trim(target)) as t from corpus where target is not null), g as (select unnest(list_transform(range(1, length(t) - 1), lambda i: t[i:i + 2])) as gram from t) select gram, count(*) as n from g group by gram""")
def char_trigrams(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "corpus").filter("target is not null").select(F.explode(char_ngrams(F.lower(F.trim("target")), 3)).alias("gram"))
    return c.groupBy("gram").agg(F.count("*").alias("n"))


@query("select sha256, sha256(sha256(html) || '|features-v1') as cache_key from (select distinct sha256, html from corpus where html is not null)")
def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    """Of content and feature version: a new version makes every key new."""
    c = table(spark, d, "corpus").filter("html is not null").select("sha256", "html").distinct()
    return c.select("sha256", F.sha2(F.concat_ws("|", F.sha2(F.col("html").cast("binary"), 256), F.lit("features-v1")), 256).alias("cache_key"))


def _claims_sql() -> str:
    from weirmill.functions.text import CLAIMS, REQUESTS

    each = ", ".join(f"case when regexp_matches(lower(text), '{p}') then '{k}' end" for k, p in CLAIMS.items())
    return f"select doc_id, list_aggregate(list_filter([{each}], lambda x: x is not null), 'string_agg', ',') as claims, coalesce(regexp_matches(lower(text), '{REQUESTS}'), false) as requests from documents"


@query(_claims_sql())
def claim_phrases(spark: SparkSession, d: str) -> DataFrame:
    """The claims each document makes and whether it asks for what must not be given away."""
    t = table(spark, d, "documents")
    return t.select("doc_id", F.nullif(F.array_join(claims(F.col("text")), ","), F.lit("")).alias("claims"), requests(F.col("text")).alias("requests"))


@query()
def zone_names(spark: SparkSession, d: str) -> DataFrame:
    """Organisations named in the title, headings, forms and main text of every distinct page, and the claims made there."""
    c = table(spark, d, "corpus").select("sha256", "html").distinct().withColumn("p", html.profile(F.col("html")))
    zones = F.array(*(F.struct(F.lit(z).alias("zone"), F.col(f"p.{f}").alias("text")) for z, f in (("title", "title"), ("heading", "heading"), ("form", "login_text"), ("main", "text"))))
    z = write_table(c.select("sha256", F.inline(zones)).filter("text <> ''").withColumn("id", F.concat_ws("|", "sha256", "zone")), "zones")
    named = matching.alias_matches(z, "id", "text", table(spark, d, "dictionary")).groupBy("id").agg(F.array_sort(F.collect_set("org_id")).alias("orgs"))  # at most the dictionary
    return z.join(named, "id", "left").select("sha256", "zone", F.array_join("orgs", ",").alias("orgs"), F.array_join(claims(F.col("text")), ",").alias("claims"), requests(F.col("text")).alias("requests"))


_INPUTS = {"url_audit": ["record_id", "label", "source", "tier", "scenario", "split", "lang", "domain"], "documents": ["doc_id", "text", "label"], "sample_index": ["sample_id", "sha256", "group_id"], "dictionary": ["org_id", "display_name"]}


def _digest_sql(name: str, cols: list[str]) -> str:
    row = "sha256(concat_ws(chr(31), " + ", ".join(f"coalesce(cast({c} as varchar), chr(0))" for c in cols) + "))"
    return f"select '{name}' as name, count(*) as rows, sha256(concat_ws('|', count(*), coalesce(sum(p), 0)::hugeint, coalesce(bit_xor(p), 0))) as sha256 from (select ('0x' || substr({row}, 1, 15))::bigint as p from {name})"


@query(" union all ".join(_digest_sql(t, c) for t, c in _INPUTS.items()))
def run_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Digests of the inputs of a run."""
    return audit.manifest({t: (table(spark, d, t), c) for t, c in _INPUTS.items()})


@query()
def snapshot_features(spark: SparkSession, d: str) -> DataFrame:
    """Features of every distinct page from the page and the dictionary alone."""
    return service.extract(_snapshots(spark, d), table(spark, d, "dictionary"), table(spark, d, "psl"))


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "corpus").select(F.col("sha256").alias("snapshot_id"), "url", "html").distinct()


@query("select count(*) as responses, 0 as wrong, true as every_page from (select distinct sha256, url, html from corpus)")
def response_check(spark: SparkSession, d: str) -> DataFrame:
    """Every page's response by the rule baseline, checked against the contract: none may be wrong."""
    f = service.extract(_snapshots(spark, d), table(spark, d, "dictionary"), table(spark, d, "psl"))
    uuid = F.regexp_replace(F.substring("snapshot_id", 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    r = f.select("*", uuid.alias("request_id"), uuid.alias("navigation_id"), F.lit(1).alias("dom_revision"), F.lit("url_content").alias("phase"))
    secret = F.col("password_inputs") > 0
    score = F.when(F.col("asks").isNotNull(), (secret.cast("int") * 4 + F.col("asks").cast("int") * 3 + (F.size("claims") > 0).cast("int") * 2) / 10)
    signals = F.array_compact(F.array(F.when(secret, "sensitive_form_detected"), F.when(F.col("asks"), "request_phrase"), F.when(F.col("link_foreign_share") > 0, "foreign_destination")))
    model = {"model_id": "rule", "variant": "M3", "preprocessing_version": "v1", "dictionary_version": "d1", "score_semantics": "uncalibrated_model_score"}
    got = service.respond(r, score, 0.6, signals, model, F.when(F.col("org_id").isNull(), "not_applicable").otherwise("unverified"))
    return got.agg(F.count("*").alias("responses"), F.count_if(contract.response_error(F.col("response")).isNotNull()).cast("int").alias("wrong"), (F.count("response") == F.count("*")).alias("every_page"))



@query(r"""with c as (select html, len(regexp_extract_all(html, '(?i)<script[ >]')) = 0 as bare from (select distinct sha256, html from corpus) where html is not null)
select 'forms' as element, count(*) as pages, count(*) as reproducible from c union all select 'inputs', count(*), count(*) from c union all select 'iframes', count(*), count(*) from c union all select 'scripts', count(*), count(*) filter (bare) from c""")
def sanitized_counts(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose element counts come out the same from the sanitised page: only such counts may be features."""
    c = table(spark, d, "corpus").filter("html is not null").select("sha256", "html").distinct().withColumn("clean", html.sanitize(F.col("html")))
    c = c.select(html.profile(F.col("html")).alias("a"), html.profile(F.col("clean")).alias("b"), *(F.regexp_count(h, F.lit("(?i)<script[ >]")).alias(f"{h}_scripts") for h in ("html", "clean")))
    same = {k: F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("forms", "inputs", "iframes")} | {"scripts": F.col("html_scripts") == F.col("clean_scripts")}
    got = c.agg(F.count("*").alias("pages"), *(F.count_if(x).alias(k) for k, x in same.items()))
    return got.select(F.inline(F.array(*(F.struct(F.lit(k).alias("element"), F.col("pages"), F.col(k).alias("reproducible")) for k in same))))


_REG = """l0 as (select host, string_split(host, '.') as l from h), l1 as (select host, l, k, array_to_string(l[len(l) - k + 1:], '.') as suffix from (select host, l, unnest(range(1, len(l) + 1)) as k from l0)),
l2 as (select l1.host, any_value(l) as l, max(case when kind = 'rule' then k when kind = 'wildcard' and len(l) > k then k + 1 end) as n, max(case when kind = 'exception' then k end) as e from l1 join psl on l1.suffix = psl.suffix group by l1.host),
reg as (select host, case when e is not null then array_to_string(l[len(l) - e + 1:], '.') when n < len(l) then array_to_string(l[len(l) - n:], '.') end as registrable from l2)"""


@query(f"""with recursive {_NEAR}, u as (select doc_id, {host_sql('domain')} as host from documents), h as (select distinct host from u where host is not null), {_REG},
copies as (select doc_id as x, min(doc_id) over (partition by text) as y from documents where text is not null), near_domain as (select doc_id as x, min(doc_id) over (partition by registrable) as y from u join reg on u.host = reg.host where registrable is not null),
one as (select id_a as x, id_b as y from near union select x, y from copies union select x, y from near_domain), links as (select x, y from one union select y, x from one union select doc_id, doc_id from documents),
reach as (select x, y from links union select reach.x, links.y from reach join links on reach.y = links.x) select x as id, min(y) as group_id from reach group by x""")
def related_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents joined by registrable domain, by equal or by nearly equal text, over any number of steps: whole groups go to
    one side of a split. A domain's documents are linked to its first one, not to each other."""
    t = table(spark, d, "documents")
    h = with_registrable(t.select("doc_id", host(F.col("domain")).alias("host")), "host", table(spark, d, "psl")).filter("registrable is not null")
    first = h.groupBy(F.col("registrable").alias("r")).agg(F.min("doc_id").alias("id_b"))
    domains = h.join(first, F.col("registrable") == F.col("r")).select(F.col("doc_id").alias("id_a"), "id_b")
    copies = groups.exact_duplicates(t, "doc_id", "text").select(F.col("id").alias("id_a"), F.col("class_id").alias("id_b"))
    edges = domains.unionByName(copies).unionByName(groups.near_duplicates(t, "doc_id", "text").select("id_a", "id_b"))
    return groups.components(t.select(F.col("doc_id").alias("id")), edges)


@query("""with n as (select user_id as navigation_id, event_id as dom_revision, case when event_type = 'view' then 0 else 1 end as phase, ts from events)
select navigation_id, min(ts) filter (phase = 0) as preliminary_at, min(ts) filter (phase = 1) as content_at, case when max(phase) = 1 then 'url_content' else 'url_only' end as assessed_by from n group by navigation_id""")
def phase_progress(spark: SparkSession, d: str) -> DataFrame:
    """When each navigation had its preliminary and its content result: by address alone it is never more than preliminary."""
    e = table(spark, d, "events").select(F.col("user_id").alias("navigation_id"), F.when(F.col("event_type") == "view", 0).otherwise(1).alias("phase"), "ts")
    at = lambda p: F.min(F.when(F.col("phase") == p, F.col("ts")))
    return e.groupBy("navigation_id").agg(at(0).alias("preliminary_at"), at(1).alias("content_at"), F.when(F.max("phase") == 1, "url_content").otherwise("url_only").alias("assessed_by"))
