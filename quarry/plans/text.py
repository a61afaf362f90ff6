"""Text queries: hosts, indicators, decoding, tags and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import columns as C

from .catalogue import query

_HOST = "regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://(?:[^/@?#]*@)?([^/:?#]+)', 1)), '^www\\.', '')"


@query(f"SELECT host, count(*) AS n FROM (SELECT {_HOST} AS host FROM pages) GROUP BY 1")
def url_host_extract(t):
    return t("pages").groupBy(C.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT page_id, host, regexp_extract(host, '\\.([a-z]+)$', 1) IN ('com', 'org') AS accepted FROM (SELECT page_id, {_HOST} AS host FROM pages)")
def domain_tld_gate(t):
    hosts = t("pages").select("page_id", C.host(F.col("url")).alias("host"))
    return hosts.withColumn("accepted", C.tld(F.col("host")).isin("com", "org"))


@query(f"""WITH h AS (SELECT DISTINCT split_part({_HOST}, '.', 1) AS label FROM pages), c AS (SELECT label, c, count(*) AS n FROM (SELECT label, unnest(string_split(label, '')) AS c FROM h) GROUP BY 1, 2)
    SELECT label, round(0 - sum(n / length(label) * log2(n / length(label))), 3) AS bits FROM c WHERE label <> '' GROUP BY label""")
def host_entropy_dga(t):
    labels = t("pages").select(F.split(C.host(F.col("url")), r"\.")[0].alias("label")).distinct().where("label <> ''")
    return labels.withColumn("bits", F.round(C.entropy(F.col("label")), 3))


_RE = {"email": C.EMAIL, "ipv4": C.IPV4, "url": C.URL}
_DQ = {k: v.replace("'", "''") for k, v in _RE.items()}


@query(f"""SELECT kind, value, count(*) AS n FROM (SELECT 'email' AS kind, unnest(regexp_extract_all(text, '{_DQ["email"]}')) AS value FROM documents
    UNION ALL SELECT 'ipv4', unnest(regexp_extract_all(text, '{_DQ["ipv4"]}')) FROM documents
    UNION ALL SELECT 'url', unnest(regexp_extract_all(html, '{_DQ["url"]}')) FROM pages) GROUP BY 1, 2""")
def ioc_extract(t):
    found = lambda df, column, kind: df.select(F.lit(kind).alias("kind"), F.explode(F.regexp_extract_all(F.col(column), F.lit(_RE[kind]), F.lit(0))).alias("value"))
    docs = t("documents")
    every = found(docs, "text", "email").unionByName(found(docs, "text", "ipv4")).unionByName(found(t("pages"), "html", "url"))
    return every.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, base64(encode(p_name)) AS token, decode(from_base64(base64(encode(p_name)))) AS decoded FROM part")
def base64_decode(t):
    return t("part").select("p_partkey", F.base64("p_name").alias("token")).withColumn("decoded", F.decode(F.unbase64("token"), "UTF-8"))


@query("SELECT p_partkey, translate(p_name, 'abcdefghijklmnopqrstuvwxyz', 'nopqrstuvwxyzabcdefghijklm') AS turned FROM (SELECT p_partkey, lower(p_name) AS p_name FROM part)")
def rot13_decode(t):
    return t("part").select("p_partkey", C.rot13(F.lower("p_name")).alias("turned"))


_TAGS = [("credential", "password|passwd|token *="), ("contact", "@[a-z0-9.-]+[.](com|net|org)"), ("shouting", "[A-Z]{4,}!!"), ("table", "[|][^|\\n]+[|]"), ("license", "(?i)licen[cs]e|copyright")]


@query("SELECT tag, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS tag FROM documents WHERE regexp_matches(text, '{p}')" for n, p in _TAGS) + ") GROUP BY 1")
def ttp_tag_text(t):
    tags = F.filter(F.array(*(F.when(F.col("text").rlike(p), n) for n, p in _TAGS)), lambda x: x.isNotNull())
    return t("documents").select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT page_id, CASE WHEN length(p) > 1 THEN regexp_replace(p, '/$', '') ELSE p END AS path FROM (
    SELECT page_id, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[a-z]+://[^/]+(/.*)$', 1)), '[?#].*$', ''), '[/\\\\]+', '/', 'g') AS p FROM pages)""")
def path_normalize(t):
    return t("pages").select("page_id", C.path(F.regexp_extract("url", r"^[a-z]+://[^/]+(/.*)$", 1)).alias("path"))


@query(f"""SELECT class, count(*) AS n FROM (SELECT CASE WHEN greatest(o[1], o[2], o[3], o[4]) > 255 THEN 'invalid' WHEN o[1] = 127 THEN 'loopback'
    WHEN o[1] = 10 OR (o[1] = 172 AND o[2] BETWEEN 16 AND 31) OR (o[1] = 192 AND o[2] = 168) THEN 'private' WHEN o[1] = 169 AND o[2] = 254 THEN 'link_local'
    WHEN o[1] BETWEEN 224 AND 239 THEN 'multicast' ELSE 'public' END AS class
    FROM (SELECT CAST(string_split(unnest(regexp_extract_all(text, '{_DQ["ipv4"]}')), '.') AS INTEGER[]) AS o FROM documents)) GROUP BY 1""")
def ip_class(t):
    ips = t("documents").select(F.explode(F.regexp_extract_all("text", F.lit(C.IPV4), F.lit(0))).alias("ip"))
    return ips.groupBy(C.ip_class(F.col("ip")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT p.page_id, coalesce(min(d.n_docs), 0) AS n_docs, coalesce(min(d.first_doc), -1) AS first_doc FROM (SELECT page_id, regexp_extract({_HOST}, '([^.]+\\.[^.]+)$', 1) AS domain FROM pages) p
    LEFT JOIN (SELECT regexp_extract(m, '([^.@]+\\.[^.@]+)$', 1) AS domain, count(*) AS n_docs, min(doc_id) AS first_doc FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_DQ["email"]}')) AS m FROM documents) GROUP BY 1) d
    ON p.domain = d.domain GROUP BY 1""")
def ioc_finding_correlate(t):
    mails = t("documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(C.EMAIL), F.lit(0))).alias("m"))
    known = mails.groupBy(F.regexp_extract("m", r"([^.@]+\.[^.@]+)$", 1).alias("domain")).agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))
    pages = t("pages").select("page_id", F.regexp_extract(C.host(F.col("url")), r"([^.]+\.[^.]+)$", 1).alias("domain"))
    return pages.join(known, "domain", "left").select("page_id", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("first_doc", F.lit(-1)).alias("first_doc"))
