"""All queries of the core over whole tables, and their SQL twins for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures
from .functions import text as texts
from .functions import urls as U
from .operators import catalog, changes, classify, frontier, schedules, search
from .plans import crawl as crawling
from .plans.staging import fresh_path
from .sources import html, robots, sitemap, storage
from .streaming import changes as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


load = storage.load

# --- addresses --------------------------------------------------------------
_DOMAIN = "lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"


def _normal_sql(source: str, keep: str) -> str:
    """SQL of normalised addresses: `source` gives `keep` and `u`."""
    return f"""
    SELECT {keep}, CASE WHEN s IN ('http', 'https') AND h <> '' THEN s || '://' ||
             CASE WHEN s = 'http' AND suffix(h, ':80') THEN h[:-4] WHEN s = 'https' AND suffix(h, ':443') THEN h[:-5] ELSE h END ||
             CASE WHEN p = '' THEN '/' WHEN p = '/' THEN p ELSE regexp_replace(p, '/+$', '') END || CASE WHEN m = ';' THEN '' ELSE m END ||
             CASE WHEN q = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(q, '&')), '&') END END AS normalized
    FROM (SELECT *, regexp_replace(w, ';[^/]*$', '') AS p, regexp_extract(w, '(;[^/]*)$', 1) AS m FROM (
      SELECT *, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS s, {_DOMAIN.format(u='u')} AS h,
             regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS w, regexp_extract(u, '^[^?#]*\\?([^#]*)', 1) AS q
      FROM ({source}) AS src0) AS src1) AS src2"""


@query(_normal_sql("SELECT id, url AS u FROM urls", "id"))
def url_normalize(spark, d):
    return load(spark, d, "urls").select("id", U.normalize_url("url").alias("normalized"))


_VARIANTS = "SELECT url AS u FROM indexed_pages UNION ALL SELECT upper(url[:5]) || url[6:] || '/#top' FROM indexed_pages UNION ALL SELECT url FROM urls UNION ALL SELECT url || '?z=1&a=2' FROM indexed_pages UNION ALL SELECT url || '?a=2&z=1' FROM indexed_pages"


@query(f"SELECT normalized, count(*) AS spellings FROM ({_normal_sql(_VARIANTS, 'u')}) WHERE normalized IS NOT NULL GROUP BY 1")
def url_dedup(spark, d):
    u = load(spark, d, "indexed_pages").select("url")
    spelled = F.explode(F.array("url", F.concat(F.upper(F.substring("url", 1, 5)), F.expr("substring(url, 6)"), F.lit("/#top")), F.concat("url", F.lit("?z=1&a=2")), F.concat("url", F.lit("?a=2&z=1"))))
    every = u.select(spelled.alias("url")).unionByName(load(spark, d, "urls").select("url"))
    return every.select(U.normalize_url("url").alias("normalized")).where("normalized is not null").groupBy("normalized").agg(F.count("*").alias("spellings"))


@query(f"""SELECT domain, count(*) AS pages, coalesce(sum(word_count), 0)::BIGINT AS words FROM (SELECT {_DOMAIN.format(u='url')} AS domain, word_count FROM indexed_pages)
           WHERE domain <> '' GROUP BY 1 ORDER BY pages DESC, domain LIMIT 10""")
def url_domain_topk(spark, d):
    return catalog.top_domains(load(spark, d, "indexed_pages").select(U.get_domain("url").alias("domain"), "word_count"))


@query(f"""SELECT id, CASE WHEN h <> '' THEN h || CASE WHEN length(p) > 30 THEN p[:30] || '...' ELSE p END ELSE url[:40] END AS shown,
             CASE WHEN q = '' THEN '/' ELSE q END || CASE WHEN qq = '' THEN '' ELSE '?' || qq END AS robots_path
           FROM (SELECT id, url, {_DOMAIN.format(u='url')} AS h, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS p,
                   regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), ';[^/]*$', '') AS q, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS qq FROM urls)""")
def url_display(spark, d):
    return load(spark, d, "urls").select("id", U.display_url("url").alias("shown"), U.robots_path("url").alias("robots_path"))


_REL = "regexp_replace(dst, '^[a-z]+://[^/?#]*', '')"
_BASE = "regexp_extract(src, '^([a-z]+://[^/?#]*)', 1)"


@query(f"""
    SELECT src, dst, dst AS absolute, regexp_extract(src, '^([a-z]+:)', 1) || regexp_replace(dst, '^[a-z]+:', '') AS without_scheme,
           {_BASE} || CASE WHEN starts_with({_REL}, '/') THEN {_REL} ELSE '/' || {_REL} END AS rooted,
           {_BASE} || regexp_replace('/' || regexp_replace(regexp_replace(src, '^[a-z]+://[^/?#]*/?', ''), '[?#].*$', ''), '[^/]*$', '') || 'next/page' AS beside,
           CASE WHEN starts_with(dst, 'http') THEN dst ELSE 'https://' || dst END AS with_scheme
    FROM (SELECT url AS src, unnest(links).url AS dst FROM parsed_pages)""")
def url_resolve(spark, d):
    """Links resolved against their page: as stored, without scheme, from the
    host's root, and a reference beside the page."""
    edges = load(spark, d, "parsed_pages").select(F.col("url").alias("src"), F.explode("links.url").alias("dst"))
    path = F.regexp_replace("dst", "^[a-z]+://[^/?#]*", "")
    made = edges.withColumns({"_loose": F.regexp_replace("dst", "^[a-z]+:", ""), "_rooted": F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)), "_beside": F.lit("next/page")})
    return made.select(
        "src", "dst", U.resolve_url("src", "dst").alias("absolute"), U.resolve_url("src", "_loose").alias("without_scheme"), U.resolve_url("src", "_rooted").alias("rooted"),
        U.resolve_url("src", "_beside").alias("beside"), U.default_scheme("dst").alias("with_scheme"),
    )


@query("""SELECT src, dst, lower(regexp_extract(src, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) = lower(regexp_extract(dst, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS internal
          FROM (SELECT url AS src, unnest(links).url AS dst FROM parsed_pages)""")
def url_internal(spark, d):
    """Which links stay on their page's host."""
    edges = load(spark, d, "parsed_pages").select(F.col("url").alias("src"), F.explode("links.url").alias("dst"))
    return edges.withColumn("internal", U.is_internal("dst", "src"))


# --- pages and links --------------------------------------------------------
def _escaped(c: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(sign), F.lit(entity))
    return c


def rendered_pages(spark, d) -> DataFrame:
    """(url, html): a page for each stored one, with its metadata, title, text as
    paragraphs, and links, between a script and a footer that are no text."""
    pages = load(spark, d, "indexed_pages").select("url", "title", "content")
    parsed = load(spark, d, "parsed_pages").select("url", "metadata", "links")
    joined = pages.join(parsed, "url")
    text = lambda c: _escaped(F.coalesce(c, F.lit("")))
    paragraphs = F.array_join(F.transform(F.split(text(F.col("content")), "\n", -1), lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))), "")
    anchors = F.array_join(F.transform("links", lambda x: F.concat(F.lit('<a href="'), text(x["url"]), F.when(x["nofollow"], F.lit('" rel="nofollow')).otherwise(F.lit("")), F.lit('">'), text(x["text"]), F.lit("</a>"))), "")
    html_ = F.concat(
        F.lit("<!doctype html><html><head><title>"), text(F.col("title")), F.lit('</title><meta name="description" content="'), text(F.col("metadata.description")), F.lit('"><meta name="robots" content="'),
        text(F.col("metadata.robots")), F.lit('"><script>var p = "no <b>text</b>";</script></head><body>'), paragraphs, F.lit("<h2>Links</h2>"), anchors, F.lit("<footer>no text</footer></body></html>"),
    )
    return joined.select("url", html_.alias("html"))


_LETTERS = "regexp_replace({c}, '[^\\p{{L}}\\p{{N}}]', '', 'g')"


@query(f"""
    SELECT p.url, trim(coalesce(p.title, '')) AS title, coalesce(m.metadata.description, '') AS description, coalesce(m.metadata.robots, '') AS robots,
           md5({_LETTERS.format(c="coalesce(p.title, '') || coalesce(p.content, '') || 'Links' || array_to_string([coalesce(x.text, '') for x in m.links], '')")}) AS text_hash,
           len(m.links) AS n_links, len([x.url for x in m.links if x.nofollow]) AS n_nofollow, len([x.url for x in m.links if lower(regexp_extract(x.url, '^[a-zA-Z]+://([^/?#]*)', 1)) = lower(regexp_extract(p.url, '^[a-zA-Z]+://([^/?#]*)', 1))]) AS n_internal,
           md5(array_to_string([x.url for x in m.links], ' ')) AS links_hash
    FROM indexed_pages p JOIN parsed_pages m ON m.url = p.url""")
def html_pages(spark, d):
    """Pages parsed from HTML that the stored ones were rendered to: what was put
    in comes out again.  Text is compared by its letters and digits."""
    parsed = html.parse_pages(rendered_pages(spark, d))
    return parsed.select(
        "url", "metadata.title", "metadata.description", "metadata.robots", F.md5(F.regexp_replace("text_content", r"[^\p{L}\p{N}]", "")).alias("text_hash"),
        F.size("links").cast("long").alias("n_links"), F.size(F.filter("links", lambda x: x["nofollow"])).cast("long").alias("n_nofollow"),
        F.size(F.filter("links", lambda x: x["is_internal"])).cast("long").alias("n_internal"), F.md5(F.array_join(F.transform("links", lambda x: x["url"]), " ")).alias("links_hash"),
    )


@query()
def html_parse_full(spark, d):
    parsed = html.parse_pages(fixtures.html_pages(spark))
    return parsed.select(
        "url", "metadata.title", "metadata.description", "metadata.language", "metadata.canonical_url", "text_content", F.size("links").alias("n_links"),
        F.to_json("headings").alias("headings"), F.size("images").alias("n_images"), F.size("structured_data").alias("n_structured"),
    )


@query(f"""SELECT url, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, trim(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)) AS h1 FROM {fixtures.values_sql(fixtures.HTML_PAGES, 'url, html')}""")
def html_titles(spark, d):
    parsed = html.parse_pages(fixtures.html_pages(spark))
    return parsed.select("url", F.coalesce("metadata.title", F.lit("")).alias("title"), F.coalesce(F.try_element_at(F.col("headings")["h1"], F.lit(1)), F.lit("")).alias("h1"))


@query()
def html_change_text(spark, d):
    return html.page_texts(fixtures.html_pages(spark))


@query()
def jsonld_extract(spark, d):
    items = html.structured_variants(html.parse_pages(fixtures.html_pages(spark)))
    return items.select("url", "pos", F.variant_get("item", "$['@type']", "string").alias("kind"))


@query("""SELECT src, dst, count(*) AS links, sum(nofollow::INT)::BIGINT AS nofollow FROM (SELECT url AS src, l.url AS dst, l.nofollow AS nofollow FROM (SELECT url, unnest(links) AS l FROM parsed_pages)) GROUP BY 1, 2""")
def link_graph(spark, d):
    edges = html.link_edges(load(spark, d, "parsed_pages"))
    return edges.groupBy("src", "dst").agg(F.count("*").alias("links"), F.sum(F.col("nofollow").cast("long")).alias("nofollow"))


@query(f"""SELECT domain, sum(i)::BIGINT AS links_in, sum(o)::BIGINT AS links_out FROM (
             SELECT {_DOMAIN.format(u='l.url')} AS domain, 1 AS i, 0 AS o FROM (SELECT unnest(links) AS l FROM parsed_pages) UNION ALL
             SELECT {_DOMAIN.format(u='url')}, 0, len(links) FROM parsed_pages) GROUP BY 1""")
def link_degree(spark, d):
    parsed = load(spark, d, "parsed_pages").select("url", F.col("links.url").alias("targets"))
    into = parsed.select(F.explode("targets").alias("u")).select(U.get_domain("u").alias("domain"), F.lit(1).alias("i"), F.lit(0).alias("o"))
    out = parsed.select(U.get_domain("url").alias("domain"), F.lit(0).alias("i"), F.size("targets").alias("o"))
    return into.unionByName(out).groupBy("domain").agg(F.sum("i").alias("links_in"), F.sum("o").alias("links_out"))


@query("""WITH l AS (SELECT url AS src, metadata.robots AS robots, unnest(links) AS l, generate_subscripts(links, 1) AS pos FROM parsed_pages)
          SELECT src, l.url AS dst, row_number() OVER (PARTITION BY src ORDER BY min(pos)) AS position FROM l
          WHERE NOT l.nofollow AND l.is_internal AND NOT coalesce(contains(lower(robots), 'nofollow'), false) GROUP BY src, l.url""")
def crawlable_links(spark, d):
    parsed = load(spark, d, "parsed_pages")
    urls = parsed.select(F.col("url").alias("src"), html.crawlable_links(F.col("links"), F.col("metadata.robots")).alias("urls"))
    return urls.select("src", F.posexplode("urls").alias("pos", "dst")).select("src", "dst", (F.col("pos") + 1).cast("long").alias("position"))


# --- robots and sitemaps ----------------------------------------------------
@query(f"""WITH f AS {fixtures.values_sql(fixtures.ROBOTS, 'domain, base_url, content')},
  raw AS (SELECT domain, unnest(string_split(content, chr(10))) AS raw, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS pos FROM f),
  d AS (SELECT domain, pos, lower(trim(string_split(line, ':')[1])) AS name, trim(line[strpos(line, ':') + 1:]) AS value FROM (SELECT domain, pos, trim(string_split(raw, '#')[1]) AS line FROM raw) WHERE contains(line, ':')),
  k AS (SELECT *, lag(name) OVER (PARTITION BY domain ORDER BY pos) AS before FROM d WHERE name IN ('user-agent', 'allow', 'disallow', 'crawl-delay')),
  g AS (SELECT *, sum((name = 'user-agent' AND coalesce(before, '') <> 'user-agent')::INT) OVER (PARTITION BY domain ORDER BY pos) AS grp FROM k),
  m AS (SELECT *, max(CASE WHEN name = 'user-agent' THEN CASE WHEN value = '*' THEN 0 WHEN value <> '' AND contains('loombot', lower(value)) THEN length(value) END END) OVER (PARTITION BY domain, grp) AS mt FROM g),
  b AS (SELECT *, max(mt) OVER (PARTITION BY domain) AS best FROM m)
  SELECT domain, pos::INT AS pos, name AS kind, CASE WHEN name <> 'crawl-delay' THEN value END AS pattern, CASE WHEN name = 'crawl-delay' THEN TRY_CAST(value AS DOUBLE) END AS delay FROM b
  WHERE mt = best AND name <> 'user-agent' AND (CASE WHEN name = 'crawl-delay' THEN TRY_CAST(value AS DOUBLE) IS NOT NULL ELSE value <> '' END)""")
def robots_parse(spark, d):
    return robots.rules(fixtures.robots_files(spark), "LoomBot")


_RULES = [("blog.pelva-daily.invalid", "disallow", "/promise/"), ("blog.pelva-daily.invalid", "allow", "/promise/list"), ("www.dramar.example", "disallow", "/*/list-*0$"), ("www.dramar.example", "allow", "/kitchen")]
_RULES_TEXT = [(h, f"https://{h}/robots.txt", "User-agent: *\n" + "".join(f"{k}: {p}\n" for hh, k, p in _RULES if hh == h)) for h in sorted({r[0] for r in _RULES})]


@query(f"""WITH r AS (SELECT domain, kind, pattern, '^' || regexp_replace(regexp_replace(CASE WHEN suffix(pattern, '$') THEN pattern[:-2] ELSE pattern END, '([.\\\\+?^${{}}()|\\[\\]])', '\\\\\\1', 'g'), '\\*', '.*', 'g') || CASE WHEN suffix(pattern, '$') THEN '$' ELSE '' END AS rx
             FROM {fixtures.values_sql(_RULES, 'domain, kind, pattern')}),
  u AS (SELECT id, {_DOMAIN.format(u='url')} AS h, regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), ';[^/]*$', '') AS p, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS q FROM indexed_pages),
  v AS (SELECT id, h, CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN q = '' THEN '' ELSE '?' || q END AS path FROM u)
  SELECT id, coalesce(max(CASE WHEN kind = 'allow' AND regexp_matches(path, rx) THEN length(pattern) END), -1) >= coalesce(max(CASE WHEN kind = 'disallow' AND regexp_matches(path, rx) THEN length(pattern) END), -1) AS allowed
  FROM v LEFT JOIN r ON r.domain = v.h GROUP BY id""")
def robots_allowed(spark, d):
    files = spark.createDataFrame(_RULES_TEXT, "domain string, base_url string, content string")
    return robots.can_fetch(load(spark, d, "indexed_pages").select("id", "url"), files).select("id", "allowed")


@query()
def robots_checks(spark, d):
    return robots.can_fetch(fixtures.robots_paths(spark), fixtures.robots_files(spark), "LoomBot")


@query("""SELECT domain, url, (row_number() OVER (PARTITION BY domain ORDER BY depth, url) - 1) * greatest(greatest(coalesce(CASE WHEN domain = 'www.dramar.example' THEN 5.0 END, 0.5), 0.5), 0.5)::DOUBLE AS slot
          FROM (SELECT url, min(depth) AS depth, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS domain FROM urls WHERE status = 'pending' GROUP BY url)""")
def crawl_delay_plan(spark, d):
    items = load(spark, d, "urls").where("status = 'pending'").groupBy("url").agg(F.min("depth").alias("depth")).withColumn("priority", F.lit(frontier.NORMAL))
    items = items.withColumn("delay", F.when(U.get_domain("url") == "www.dramar.example", 5.0))
    return frontier.fetch_slots(items, robots.effective_delay(F.col("delay"))).select("domain", "url", F.col("slot").cast("double").alias("slot"))


@query(f"""WITH f AS {fixtures.values_sql(fixtures.SITEMAPS, 'sitemap_url, content')}
  SELECT sitemap_url, CASE WHEN contains(content, '<sitemapindex') THEN 'sitemap' ELSE 'url' END AS kind, trim(unnest(regexp_extract_all(content, '(?i)<loc>\\s*([^<]+)\\s*</loc>', 1))) AS loc FROM f""")
def sitemap_parse(spark, d):
    return sitemap.parse_sitemaps(fixtures.sitemap_files(spark)).select("sitemap_url", "kind", "loc")


@query(f"""WITH RECURSIVE f AS {fixtures.values_sql(fixtures.SITEMAPS, 'sitemap_url, content')},
  e AS (SELECT sitemap_url, contains(content, '<sitemapindex') AS idx, trim(unnest(regexp_extract_all(content, '(?i)<loc>\\s*([^<]+)\\s*</loc>', 1))) AS loc FROM f),
  w(u, level) AS (SELECT 'https://site.example/maps/index.xml', 0 UNION SELECT e.loc, w.level + 1 FROM w JOIN e ON e.sitemap_url = w.u AND e.idx WHERE w.level < 3),
  v AS (SELECT u, min(level) AS level FROM w GROUP BY u)
  SELECT e.loc AS url, v.level::INT AS level FROM v JOIN e ON e.sitemap_url = v.u WHERE NOT e.idx""")
def sitemap_expand(spark, d):
    start = spark.createDataFrame([("https://site.example/maps/index.xml",)], "sitemap_url string")
    return sitemap.expand_sitemaps(fixtures.sitemap_files(spark), start).select(F.col("loc").alias("url"), "level")


@query(f"""WITH r AS {fixtures.values_sql(fixtures.ROBOTS, 'domain, base_url, content')}, f AS {fixtures.values_sql(fixtures.SITEMAPS, 'sitemap_url, content')}
  SELECT domain, domain || unnest(regexp_extract_all(content, '(?i)sitemap:\\s*(/\\S+)', 1)) AS place FROM r UNION
  SELECT domain, domain || p.place FROM r, (SELECT unnest({sitemap.WELL_KNOWN!r}) AS place) p WHERE 'https://' || domain || p.place IN (SELECT sitemap_url FROM f)""")
def sitemap_discover(spark, d):
    files = fixtures.robots_files(spark)
    found = sitemap.discover(files.select("domain"), robots.sitemaps(files), fixtures.sitemap_files(spark))
    return found.select("domain", F.regexp_replace("sitemap_url", "^https://", "").alias("place"))


@query(f"""WITH RECURSIVE f AS {fixtures.values_sql(fixtures.SITEMAPS, 'sitemap_url, content')},
  e AS (SELECT sitemap_url, contains(content, '<sitemapindex') AS idx, trim(unnest(regexp_extract_all(content, '(?i)<loc>\\s*([^<]+)\\s*</loc>', 1))) AS loc FROM f),
  w(start, u, level) AS (SELECT sitemap_url, sitemap_url, 0 FROM (SELECT DISTINCT sitemap_url FROM f ORDER BY 1 LIMIT 5) UNION SELECT w.start, e.loc, w.level + 1 FROM w JOIN e ON e.sitemap_url = w.u AND e.idx WHERE w.level < 3),
  v AS (SELECT DISTINCT start, u FROM w)
  SELECT v.start, e.loc AS url, 1 AS depth, 'HIGH' AS priority FROM v JOIN e ON e.sitemap_url = v.u WHERE NOT e.idx""")
def sitemap_seeds(spark, d):
    start = fixtures.sitemap_files(spark).select("sitemap_url")
    return sitemap.seeds(sitemap.expand_sitemaps(fixtures.sitemap_files(spark), start))


# --- frontier and crawl -----------------------------------------------------
def _queued(spark, d) -> DataFrame:
    rows = storage.deduplicated(load(spark, d, "urls")).where("status = 'pending'")
    return rows.select("url", F.lit(frontier.NORMAL).alias("priority"), "depth", "parent_url")


@query("""SELECT url, depth FROM (SELECT url, min(depth) AS depth FROM urls WHERE status = 'pending' GROUP BY url) ORDER BY depth, url LIMIT 100""")
def frontier_next(spark, d):
    best = _queued(spark, d).groupBy("url").agg(F.min("depth").alias("depth")).withColumn("priority", F.lit(frontier.NORMAL))
    return frontier.next_batch(best, 100).select("url", "depth")


_SEEN = "SELECT DISTINCT normalized FROM (" + _normal_sql("SELECT url AS u FROM urls WHERE status <> 'pending'", "u") + ")"


@query(f"""WITH c AS ({_normal_sql("SELECT url AS u, depth FROM urls WHERE status = 'pending'", 'depth')}), seen AS ({_SEEN})
           SELECT normalized AS url, min(depth) AS depth FROM c WHERE normalized IS NOT NULL AND normalized NOT IN (SELECT normalized FROM seen WHERE normalized IS NOT NULL) GROUP BY 1""")
def frontier_admit(spark, d):
    seen = load(spark, d, "urls").where("status != 'pending'").select(U.normalize_url("url").alias("url")).where("url is not null").distinct()
    return frontier.admit(_queued(spark, d), seen).select("url", "depth")


@query("""SELECT url, least(1 + depth % 4 + 1, 3)::INT AS priority, (depth % 5 + 1)::INT AS retry_count FROM (SELECT DISTINCT id, url, depth FROM urls WHERE status = 'failed') WHERE depth % 5 < 3""")
def frontier_retry(spark, d):
    failed = storage.deduplicated(load(spark, d, "urls")).where("status = 'failed'").select("url", (F.lit(1) + F.col("depth") % 4).alias("priority"), (F.col("depth") % 5).alias("retry_count"))
    return frontier.retry(failed)


@query("""SELECT count(*) FILTER (status = 'pending') AS queue_size, 0::BIGINT AS in_progress, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS errors, count(*) AS seen
          FROM (SELECT DISTINCT id, status FROM urls)""")
def frontier_counters(spark, d):
    state = F.when(F.col("status") == "pending", "queued").otherwise(F.col("status"))
    return frontier.counters(storage.deduplicated(load(spark, d, "urls")).select(state.alias("state")))


_BIT = "(('0x' || md5(url || i::VARCHAR)[1:16])::UBIGINT::HUGEINT % 1000000 * 551616 + ('0x' || md5(url || i::VARCHAR)[17:32])::UBIGINT::HUGEINT) % 1000000"


@query(f"""WITH b AS (SELECT DISTINCT {_BIT} AS bit FROM (SELECT DISTINCT url FROM indexed_pages), range(5) r(i)),
  c AS (SELECT DISTINCT url, {_BIT} AS bit FROM (SELECT DISTINCT url FROM urls), range(5) r(i))
  SELECT url, count(*) = count(b.bit) AS maybe FROM c LEFT JOIN b USING (bit) GROUP BY url""")
def bloom_membership(spark, d):
    bits = frontier.bloom_filter(load(spark, d, "indexed_pages").select("url").distinct(), "url")
    return frontier.bloom_contains(load(spark, d, "urls"), "url", bits)


def _crawl_inputs(spark, d):
    records = load(spark, d, "urls").where("parent_url is not null").select(F.col("parent_url").alias("src"), F.col("url").alias("dst"))
    links = html.link_edges(load(spark, d, "parsed_pages")).where("is_internal and not nofollow").select("src", "dst").unionByName(records)
    pages = load(spark, d, "indexed_pages").select("url").unionByName(load(spark, d, "urls").where("parent_url is not null").select(F.col("parent_url").alias("url")))
    return load(spark, d, "crawl_sessions").select(F.col("seed_url").alias("url")), links, pages


@query(f"""WITH RECURSIVE pages AS MATERIALIZED (SELECT DISTINCT normalized AS url FROM ({_normal_sql("SELECT url AS u FROM indexed_pages UNION SELECT parent_url FROM urls WHERE parent_url IS NOT NULL", 'u')}) WHERE normalized IS NOT NULL),
  raw AS (SELECT url AS s, l.url AS t FROM (SELECT url, unnest(links) AS l FROM parsed_pages) WHERE l.is_internal AND NOT l.nofollow UNION SELECT parent_url, url FROM urls WHERE parent_url IS NOT NULL),
  ns AS MATERIALIZED (SELECT DISTINCT u, normalized FROM ({_normal_sql("SELECT s AS u FROM raw UNION SELECT t FROM raw UNION SELECT seed_url FROM crawl_sessions", 'u')})),
  edges AS MATERIALIZED (SELECT DISTINCT a.normalized AS src, b.normalized AS dst FROM raw JOIN ns a ON a.u = raw.s JOIN ns b ON b.u = raw.t WHERE a.normalized IS NOT NULL AND b.normalized IS NOT NULL),
  w(url, depth) AS (SELECT DISTINCT normalized, 0 FROM ns JOIN crawl_sessions ON seed_url = u WHERE normalized IS NOT NULL UNION
    SELECT e.dst, w.depth + 1 FROM w JOIN pages p ON p.url = w.url JOIN edges e ON e.src = w.url WHERE w.depth < 3)
  SELECT w.url, min(depth)::INT AS depth, CASE WHEN max(p.url) IS NOT NULL THEN 'completed' ELSE 'failed' END AS outcome FROM w LEFT JOIN pages p ON p.url = w.url GROUP BY w.url""")
def crawl_bfs(spark, d):
    result = crawling.crawl(*_crawl_inputs(spark, d), max_pages=2_000_000_000, max_depth=3)
    return result.urls.select("url", "depth", "outcome")


@query()
def crawl_progress(spark, d):
    result = crawling.crawl(*_crawl_inputs(spark, d), max_pages=500, max_depth=10)
    return crawling.progress(result.urls, 500)


# --- sessions and records ---------------------------------------------------
@query("""SELECT session_id, count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'pending') AS pending
          FROM (SELECT DISTINCT id, session_id, status FROM urls) GROUP BY 1""")
def session_status_pivot(spark, d):
    return catalog.status_counts(storage.deduplicated(load(spark, d, "urls")))


@query("""SELECT session_id, count(*) FILTER (good AND status <> 'pending') AS crawled, count(*) FILTER (NOT good AND status <> 'pending') AS failed, 0::BIGINT AS skipped, count(*) FILTER (status <> 'pending') AS total
          FROM (SELECT DISTINCT id, session_id, status, coalesce(http_status BETWEEN 200 AND 399, false) AND error IS NULL AS good FROM urls) GROUP BY 1""")
def session_outcomes(spark, d):
    return catalog.crawl_totals(catalog.outcome(storage.deduplicated(load(spark, d, "urls"))))


@query(f"""SELECT session_id, {_DOMAIN.format(u='url')} AS domain, count(*) AS requests, count(*) FILTER (status = 'failed') AS failures FROM (SELECT DISTINCT id, session_id, url, status FROM urls) GROUP BY 1, 2""")
def domain_counters(spark, d):
    return catalog.domain_stats(storage.deduplicated(load(spark, d, "urls")), U.get_domain("url")).drop("last_request")


@query("""SELECT content_type, count(*) AS records, coalesce(max(contains(lower(content_type), 'text/html') OR contains(lower(content_type), 'xhtml')), false) AS html FROM (SELECT DISTINCT id, content_type FROM urls) GROUP BY 1""")
def content_types(spark, d):
    rows = storage.deduplicated(load(spark, d, "urls"))
    return rows.groupBy("content_type").agg(F.count("*").alias("records"), F.max(catalog.is_html(F.col("content_type"))).alias("html"))


@query("SELECT id, seed_url, status, pages_crawled FROM crawl_sessions ORDER BY id DESC LIMIT 20")
def session_history(spark, d):
    return catalog.history(load(spark, d, "crawl_sessions")).select("id", "seed_url", "status", "pages_crawled")


@query("SELECT DISTINCT id, url, depth FROM (SELECT DISTINCT id, url, depth FROM urls WHERE session_id = 1 AND status = 'pending') ORDER BY depth, id LIMIT 100")
def pending_urls(spark, d):
    return catalog.pending(storage.deduplicated(load(spark, d, "urls")), 1).select("id", "url", "depth")


@query("SELECT id, seed_url FROM crawl_sessions WHERE status = 'running' ORDER BY id DESC LIMIT 1")
def session_resume(spark, d):
    return catalog.resumable(load(spark, d, "crawl_sessions")).select("id", "seed_url")


@query("""SELECT id, seed_url, CASE WHEN id = 2 THEN 'interrupted' ELSE status END AS status FROM crawl_sessions UNION ALL SELECT 1000000, 'https://new.example/', 'running'""")
def session_lifecycle(spark, d):
    now = F.lit(fixtures.NOW).cast("timestamp")
    sessions = catalog.start_session(load(spark, d, "crawl_sessions"), 1_000_000, "https://new.example/", now)
    return catalog.close_session(sessions, 2, "interrupted", now).select("id", "seed_url", "status")


@query("SELECT url, title, description, crawled_at FROM indexed_pages")
def export_projection(spark, d):
    return storage.projection(load(spark, d, "indexed_pages"))


# --- search -----------------------------------------------------------------
_COLS = [("url", 0), ("title", 1), ("content", 2), ("description", 3)]
_TOK = "regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{N}}]+')"
_LISTS = " UNION ALL ".join(f"SELECT id AS doc_id, {i} AS col, {_TOK.format(c=c)} AS t FROM indexed_pages" for c, i in _COLS)
_POSTINGS = f"lists AS ({_LISTS}), post AS (SELECT doc_id, col, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM lists), lens AS (SELECT doc_id, sum(len(t)) AS len FROM lists GROUP BY 1), corpus AS (SELECT count(*) AS n_docs, avg(len) AS mean_len FROM lens)"


def _bm25_sql(leaves: list[str], where: str, tail: str = "", also: str = "") -> str:
    """SQL of ranking: each leaf is a query giving (doc_id, tf)."""
    ctes = ", ".join(f"l{k} AS ({leaf})" for k, leaf in enumerate(leaves))
    joins = " ".join(f"LEFT JOIN l{k} ON l{k}.doc_id = lens.doc_id" for k in range(len(leaves)))
    idf = "greatest(ln((n_docs - n{k} + 0.5::DOUBLE) / (n{k} + 0.5::DOUBLE)), 1e-6::DOUBLE)"
    score = " + ".join(f"coalesce({idf.format(k=k)} * l{k}.tf::DOUBLE * 2.2::DOUBLE / (l{k}.tf::DOUBLE + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean_len)), 0)" for k in range(len(leaves)))
    counts = ", ".join(f"(SELECT count(*) FROM l{k}) AS n{k}" for k in range(len(leaves)))
    return f"WITH {_POSTINGS}, {ctes}, cnt AS (SELECT {counts}) SELECT lens.doc_id, round({score}, 6) AS score FROM lens {joins}, corpus, cnt {also} WHERE {where} {tail}"


def _term(cond: str) -> str:
    return f"SELECT doc_id, count(*) AS tf FROM post WHERE {cond} GROUP BY 1"


def _phrase(a: str, b: str) -> str:
    return f"SELECT x.doc_id, count(*) AS tf FROM post x JOIN post y ON x.doc_id = y.doc_id AND x.col = y.col AND y.pos = x.pos + 1 WHERE x.term = '{a}' AND y.term = '{b}' GROUP BY 1"


_indexes: dict[tuple, tuple[DataFrame, DataFrame]] = {}


def _index(spark, d, stem: bool = False) -> tuple[DataFrame, DataFrame]:
    """Stored index over all pages, (postings, lengths): written once for each
    application and data directory, then read by every search."""
    key = (spark.sparkContext.applicationId, d, stem)
    if key not in _indexes:
        _indexes[key] = search.stored_index(load(spark, d, "indexed_pages"), fresh_path(spark, "index"), stem=stem)
    return _indexes[key]


def _ranked(spark, d, text: str, stem: bool = False) -> DataFrame:
    return search.bm25(*_index(spark, d, stem), search.parse_query(text, stem=stem)).select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {_POSTINGS} SELECT term, count(*) AS occurrences, count(DISTINCT doc_id) AS documents FROM post GROUP BY 1")
def search_postings(spark, d):
    index, _ = _index(spark, d)
    per_doc = index.groupBy("term", "doc_id").agg(F.count("*").alias("tf"))
    return per_doc.groupBy("term").agg(F.sum("tf").alias("occurrences"), F.count("*").alias("documents"))


@query(_bm25_sql([_term("term = 'telescope'"), _term("term = 'another'")], "l0.doc_id IS NOT NULL AND l1.doc_id IS NOT NULL"))
def search_bm25(spark, d):
    return _ranked(spark, d, "telescope another")


@query(_bm25_sql([_term("term = 'telescope'"), _term("term = 'vaccine'")], "l0.doc_id IS NOT NULL OR l1.doc_id IS NOT NULL"))
def search_bm25_or(spark, d):
    return _ranked(spark, d, "telescope OR vaccine")


@query(_bm25_sql([_term("term = 'telescope'"), _term("term = 'another'")], "l0.doc_id IS NOT NULL AND l1.doc_id IS NULL"))
def search_not(spark, d):
    return _ranked(spark, d, "telescope NOT another")


@query(_bm25_sql([_phrase("useful", "habit")], "l0.doc_id IS NOT NULL"))
def search_phrase(spark, d):
    return _ranked(spark, d, '"useful habit"')


@query(_bm25_sql([_term("starts_with(term, 'micro')")], "l0.doc_id IS NOT NULL"))
def search_prefix(spark, d):
    return _ranked(spark, d, "micro*")


@query(_bm25_sql([_term("starts_with(term, 'telescop')")], "l0.doc_id IS NOT NULL", "ORDER BY score DESC, doc_id LIMIT 20 OFFSET 20"))
def search_page2(spark, d):
    store = load(spark, d, "indexed_pages")
    rows, _ = search.search(store, *_index(spark, d), "telescop", page=2, stem=False)
    return rows.select("doc_id", "score")


@query(_bm25_sql([_term("starts_with(term, 'habit')")], "l0.doc_id IS NOT NULL AND p.domain ILIKE '%PRESS%'", "ORDER BY score DESC, lens.doc_id LIMIT 100", ", indexed_pages p").replace("WHERE l0", "WHERE p.id = lens.doc_id AND l0"))
def search_domain_filter(spark, d):
    store = load(spark, d, "indexed_pages")
    rows, _ = search.search(store, *_index(spark, d), "habit", per_page=100, domain="PRESS", stem=False)
    return rows.select("doc_id", "score")


# the forms that the Porter stemmer takes to one stem, for the terms of the query
_STEM_TERM = "strip_accents(term)"
_TELESCOP = f"regexp_full_match({_STEM_TERM}, 'telescop(e|es|ed|ing|s|ic|ics|ical|ically)?')"
_MEASUR = f"regexp_full_match({_STEM_TERM}, 'measur(e|es|ed|ing|s|er|ers|able|ement|ements)?')"


@query(_bm25_sql([_term(_TELESCOP), _term(_MEASUR)], "l0.doc_id IS NOT NULL OR l1.doc_id IS NOT NULL"))
def search_porter(spark, d):
    """Ranking over folded and stemmed terms."""
    return _ranked(spark, d, "telescopes OR measuring", stem=True)


@query(_bm25_sql([f"SELECT x.doc_id, count(*) AS tf FROM post x JOIN post y ON x.doc_id = y.doc_id AND x.col = y.col AND y.pos = x.pos + 1 WHERE {_TELESCOP.replace('(term)', '(x.term)')} AND {_MEASUR.replace('(term)', '(y.term)')} GROUP BY 1"], "l0.doc_id IS NOT NULL"))
def search_porter_phrase(spark, d):
    """A phrase over stemmed terms."""
    return _ranked(spark, d, '"telescope measures"', stem=True)


@query()
def search_stemmed(spark, d):
    """Stemmed and accent-folded search with snippets, first page."""
    store = load(spark, d, "indexed_pages")
    rows, _ = search.search(store, *_index(spark, d, stem=True), "telescopes measuring")
    return rows.drop("crawled_at")


@query("SELECT count(*) AS total_pages, coalesce(sum(word_count), 0)::BIGINT AS total_words FROM indexed_pages")
def search_stats(spark, d):
    return catalog.corpus_totals(load(spark, d, "indexed_pages"))


@query("SELECT session_id, count(*) AS pages FROM indexed_pages WHERE session_id IS NOT NULL GROUP BY 1 ORDER BY session_id DESC LIMIT 10")
def search_sessions(spark, d):
    return catalog.latest_sessions(load(spark, d, "indexed_pages"))


@query("SELECT session_id, count(*) AS pages FROM indexed_pages WHERE session_id IS NOT NULL GROUP BY ROLLUP (session_id)")
def index_totals(spark, d):
    return catalog.indexed_totals(load(spark, d, "indexed_pages"))


_WORDS_SQL = "len([w for w in regexp_split_to_array({c}, '\\s+') if w <> ''])::BIGINT"


@query(f"""WITH v AS (SELECT url, title, text_content, captured_at, row_number() OVER (PARTITION BY url ORDER BY captured_at DESC) AS r FROM page_versions)
  SELECT p.url, p.domain, p.session_id, coalesce(v.title, CASE WHEN v.url IS NULL THEN p.title ELSE '' END) AS title, CASE WHEN v.url IS NULL THEN p.word_count ELSE {_WORDS_SQL.format(c='v.text_content')} END AS words
  FROM indexed_pages p LEFT JOIN v ON v.url = p.url AND v.r = 1""")
def index_upsert(spark, d):
    """The store after the latest version of each page has been indexed again."""
    store = load(spark, d, "indexed_pages").select("url", "title", "content", "description", "domain", "session_id", "word_count", "crawled_at")
    versions = load(spark, d, "page_versions").select("url", "title", F.col("text_content").alias("content"), F.col("captured_at").alias("crawled_at"))
    latest = catalog.latest_per(versions, "url", "crawled_at").join(store.select("url", "domain", "session_id"), "url").withColumn("description", F.lit(None).cast("string"))
    return search.upsert(store, latest).select("url", "domain", "session_id", "title", F.col("word_count").alias("words"))


@query("SELECT id, session_id FROM indexed_pages WHERE coalesce(session_id <> 1, true)")
def index_delete_session(spark, d):
    return search.delete_session(load(spark, d, "indexed_pages"), 1).select("id", "session_id")


# --- versions and changes ---------------------------------------------------
@query(f"""SELECT id, sha256(regexp_replace(lower(regexp_replace(text_content, '^{texts.SPACE}+|{texts.SPACE}+$', '', 'g')), '{texts.SPACE}+', ' ', 'g'))[1:16] AS hash, {_WORDS_SQL.format(c='text_content')} AS words FROM page_versions""")
def content_hash(spark, d):
    t = F.col("text_content")
    return load(spark, d, "page_versions").select("id", texts.content_hash(t).alias("hash"), texts.word_count(t).alias("words"))


@query("""WITH kept AS (SELECT url, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY id) AS r FROM page_versions) WHERE r = 1)
          SELECT url, content_hash, min(id) AS id FROM page_versions v WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.url = v.url AND k.content_hash = v.content_hash) GROUP BY 1, 2""")
def version_dedup(spark, d):
    """All captures against a store that holds the first version of each page."""
    rows = load(spark, d, "page_versions").select("id", "url", "content_hash")
    kept = rows.groupBy("url").agg(F.min_by("content_hash", "id").alias("content_hash"))
    return changes.new_versions(kept, rows)


@query("SELECT url, max(id) AS id FROM page_versions GROUP BY 1")
def version_latest(spark, d):
    return catalog.latest_per(load(spark, d, "page_versions").select("url", "id"), "url", "id")


@query("SELECT url, id, position FROM (SELECT url, id, row_number() OVER (PARTITION BY url ORDER BY id DESC)::INT AS position FROM page_versions) WHERE position <= 20")
def version_history(spark, d):
    return catalog.last_rows(load(spark, d, "page_versions").select("url", "id"), "url", "id", 20)


@query("SELECT DISTINCT url FROM page_versions")
def tracked_urls(spark, d):
    return load(spark, d, "page_versions").select("url").distinct()


_DETECT = """SELECT url, coalesce(old_id, 0) AS old_version_id, id AS new_version_id, CASE WHEN old_id IS NULL THEN 'added' ELSE 'modified' END AS change_type
  FROM (SELECT url, id, content_hash, lag(id) OVER w AS old_id, lag(content_hash) OVER w AS old_hash FROM page_versions WINDOW w AS (PARTITION BY url ORDER BY id)) WHERE old_id IS NULL OR old_hash <> content_hash"""


@query(_DETECT)
def changes_detect(spark, d):
    return changes.detect(load(spark, d, "page_versions"))


@query()
def changes_diff(spark, d):
    return changes.change_log(load(spark, d, "page_versions"))


@query("""SELECT id, CASE WHEN change_percent < 5 THEN 'Minor text changes' WHEN change_percent < 20 THEN 'Moderate content update' WHEN change_percent < 50 THEN 'Significant content changes' ELSE 'Major page restructure' END AS summary
          FROM (SELECT DISTINCT id, change_percent FROM content_changes)""")
def changes_severity(spark, d):
    return storage.deduplicated(load(spark, d, "content_changes")).select("id", changes.severity(F.col("change_percent")).alias("summary"))


@query("""SELECT c.id, c.url, o.title AS old_title, n.title AS new_title, n.word_count AS new_word_count FROM (SELECT DISTINCT id, url, old_version_id, new_version_id FROM content_changes) c
          LEFT JOIN page_versions o ON o.id = c.old_version_id JOIN page_versions n ON n.id = c.new_version_id ORDER BY c.id DESC LIMIT 50""")
def changes_recent(spark, d):
    found = changes.recent(storage.deduplicated(load(spark, d, "content_changes")), load(spark, d, "page_versions"))
    return found.select("id", "url", "old_title", "new_title", "new_word_count")


@query("SELECT url, id FROM (SELECT url, id, row_number() OVER (PARTITION BY url ORDER BY id DESC) AS r FROM (SELECT DISTINCT id, url FROM content_changes)) WHERE r <= 20")
def changes_per_url(spark, d):
    return catalog.last_rows(storage.deduplicated(load(spark, d, "content_changes")).select("url", "id"), "url", "id", 20).select("url", "id")


@query("""SELECT DISTINCT url, 'deleted' AS change_type FROM page_versions WHERE url NOT IN (SELECT url FROM page_versions WHERE captured_at >= TIMESTAMP '2025-03-01')""")
def changes_deleted(spark, d):
    versions = load(spark, d, "page_versions")
    return changes.deleted(versions, versions.where("captured_at >= timestamp'2025-03-01'"))


@query(_DETECT)
def changes_stream(spark, d):
    """The change log of the version table read as a stream."""
    table = load(spark, d, "page_versions")
    source = spark.readStream.schema(table.schema).parquet(f"{d}/page_versions.parque[t]")  # a pattern: the table may be a file or a folder
    place = fresh_path(spark, "changes-stream")
    run = streams.detect_stream(source).writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(streams.CHANGES).parquet(f"{place}/out")


@query(f"""SELECT id FROM {fixtures.values_sql([(1, 24, '2024-03-09 12:00:00', True), (2, 24, '2024-03-10 11:00:00', True), (3, 1, None, True), (4, 1, None, False)], 'id, hours, last_checked, is_active')}
           WHERE is_active AND (last_checked IS NULL OR last_checked::TIMESTAMP + to_hours(hours) <= TIMESTAMP '{fixtures.NOW}')""")
def monitored_due(spark, d):
    rows = [(1, 24, "2024-03-09 12:00:00", True), (2, 24, "2024-03-10 11:00:00", True), (3, 1, None, True), (4, 1, None, False)]
    monitored = spark.createDataFrame(rows, "id int, check_interval_hours int, last_checked string, is_active boolean").withColumn("last_checked", F.col("last_checked").cast("timestamp"))
    return changes.due(monitored, F.lit(fixtures.NOW).cast("timestamp")).select("id")


# --- classification ---------------------------------------------------------
_LOW = "lower(coalesce(title, '') || ' ' || coalesce(content, ''))"


def _sum_sql(words: list[str]) -> str:
    return "(" + " + ".join(f"contains(t, '{w}')::INT" for w in words) + ")"


_SCORES = "list_sort([s for s in [" + ", ".join(f"{{'score': {_sum_sql(w)}, 'ord': {-i}, 'category': '{c}'}}" for i, (c, w) in enumerate(classify.CATEGORY_KEYWORDS.items())) + "] if s.score > 0], 'DESC')"


@query(f"""SELECT id, CASE WHEN len(s) > 0 THEN s[1].category ELSE 'Unknown' END AS category, CASE WHEN len(s) > 0 THEN round(s[1].score / list_sum([x.score for x in s]), 2) ELSE 0 END::DOUBLE AS confidence,
             array_to_string([x.category for x in s[2:3]], '|') AS secondary FROM (SELECT id, {_SCORES} AS s FROM (SELECT id, {_LOW} AS t FROM indexed_pages))""")
def classify_category(spark, d):
    c = classify.classify(load(spark, d, "indexed_pages").select("id", "title", "content"), text="content")
    return c.select("id", "category", F.col("category_confidence").alias("confidence"), F.array_join("secondary_categories", "|").alias("secondary"))


@query(f"""SELECT id, CASE WHEN p > n * 1.5 THEN 'positive' WHEN n > p * 1.5 THEN 'negative' ELSE 'neutral' END AS sentiment,
             round(CASE WHEN p > n * 1.5 THEN least(1.0::DOUBLE, p::DOUBLE / (p + n + 1)) WHEN n > p * 1.5 THEN -least(1.0::DOUBLE, n::DOUBLE / (p + n + 1)) ELSE 0 END, 2) AS score
           FROM (SELECT id, {_sum_sql(classify.POSITIVE)} AS p, {_sum_sql(classify.NEGATIVE)} AS n FROM (SELECT id, {_LOW} AS t FROM indexed_pages))""")
def classify_sentiment(spark, d):
    low = classify.lowered(F.col("title"), F.col("content"))
    label, score = classify.sentiment(F.col("t"))
    return load(spark, d, "indexed_pages").select("id", low.alias("t")).select("id", label.alias("sentiment"), score.alias("score"))


_STOP = ", ".join(f"'{w}'" for w in classify.STOPWORDS)


@query(f"""WITH w AS (SELECT id, regexp_extract_all({_LOW}, '[\\p{{L}}\\p{{N}}_]+') AS ws FROM indexed_pages), o AS (SELECT id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
  c AS (SELECT id, word, count(*) AS n, min(pos) AS first FROM o WHERE length(word) > 3 AND word NOT IN ({_STOP}) GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, first) AS rank FROM c)
  SELECT w.id, coalesce(k.keywords, '') AS keywords, len(w.ws)::BIGINT AS words FROM w LEFT JOIN (SELECT id, string_agg(word, '|' ORDER BY rank) AS keywords FROM r WHERE rank <= 10 GROUP BY 1) k ON k.id = w.id""")
def classify_keywords(spark, d):
    c = classify.classify(load(spark, d, "indexed_pages").select("id", "title", "content"), text="content")
    return c.select("id", F.array_join("keywords", "|").alias("keywords"), F.col("word_count").alias("words"))


@query("""SELECT id, array_to_string([p for p in [regexp_replace(x, '^\\s+|\\s+$', '', 'g') for x in regexp_split_to_array(coalesce(content, ''), '[.!?]+')[1:3]] if length(p) > 20], '. ')[1:300] AS summary FROM indexed_pages""")
def classify_summary(spark, d):
    return load(spark, d, "indexed_pages").select("id", classify.summary(F.col("content")).alias("summary"))


@query("SELECT category, count(*) AS pages, count(*) / (SELECT count(*) FROM classification_results)::DOUBLE AS share FROM classification_results GROUP BY 1")
def classify_distribution(spark, d):
    return classify.distribution(load(spark, d, "classification_results").select("category"))


# --- schedules --------------------------------------------------------------
_AFTER = "date_trunc('minute', started_at) + INTERVAL 1 MINUTE"
_DAYS = "(SELECT date_trunc('day', started_at) + to_days(i::INT) AS d FROM range(0, {n}) AS r(i))"


@query(f"""SELECT id,
    (SELECT min(d + INTERVAL 150 MINUTE) FROM {_DAYS.format(n=3)} WHERE d + INTERVAL 150 MINUTE >= {_AFTER}) AS nightly,
    (SELECT min(d + INTERVAL 9 HOUR) FROM {_DAYS.format(n=8)} WHERE isodow(d) <= 5 AND d + INTERVAL 9 HOUR >= {_AFTER}) AS workday,
    (SELECT min(d + to_minutes(m::INT)) FROM {_DAYS.format(n=3)}, range(0, 1440, 20) AS q(m) WHERE d + to_minutes(m::INT) >= {_AFTER}) AS thrice_hourly,
    (SELECT min(d) FROM {_DAYS.format(n=3200)} WHERE month(d) = 2 AND day(d) = 29 AND d >= {_AFTER}) AS leap_day
    FROM (SELECT id, started_at AT TIME ZONE 'UTC' AS started_at FROM crawl_sessions)""")
def cron_next(spark, d):
    """Next run after the start of each session, by several crontab expressions."""
    at = F.col("started_at")
    named = {"nightly": "30 2 * * *", "workday": "0 9 * * mon-fri", "thrice_hourly": "*/20 * * * *", "leap_day": "0 0 29 2 *"}
    return load(spark, d, "crawl_sessions").select("id", *[schedules.next_cron(text, at).alias(name) for name, text in named.items()])


@query()
def schedule_next_runs(spark, d):
    return schedules.next_runs(fixtures.schedules(spark), F.lit(fixtures.NOW).cast("timestamp"))


_SCHEDULES = [(r[0], r[3], r[5], r[6], r[7], r[8]) for r in fixtures.SCHEDULES]


@query(f"""SELECT id::BIGINT AS id FROM {fixtures.values_sql(_SCHEDULES, 'id, kind, every, run_at, status, last_run')} WHERE status = 'active' AND
           CASE WHEN kind = 'interval' THEN last_run IS NULL OR last_run::TIMESTAMP + to_seconds(every) <= TIMESTAMP '{fixtures.NOW}' WHEN kind = 'once' THEN last_run IS NULL AND run_at::TIMESTAMP <= TIMESTAMP '{fixtures.NOW}' ELSE false END""")
def schedule_due(spark, d):
    return schedules.due(fixtures.schedules(spark), F.lit(fixtures.NOW).cast("timestamp")).select("id")


@query("SELECT user_id AS schedule_id, event_id AS id, position FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC)::INT AS position FROM events) WHERE position <= 10")
def schedule_runs_topn(spark, d):
    runs = load(spark, d, "events").select(F.col("user_id").alias("schedule_id"), F.col("event_id").alias("id"))
    return catalog.last_rows(runs, "schedule_id", "id", 10)


@query(f"""SELECT s.id::BIGINT AS id, s.name, count(e.event_id) AS runs FROM {fixtures.values_sql([(r[0], r[1]) for r in fixtures.SCHEDULES], 'id, name')} s LEFT JOIN events e ON e.user_id = s.id GROUP BY 1, 2""")
def schedule_run_counts(spark, d):
    runs = load(spark, d, "events").select(F.col("user_id").alias("schedule_id"), F.col("ts").alias("started_at"))
    return schedules.run_counts(fixtures.schedules(spark), runs).select("id", "name", "runs")


# --- extensions: crawl-rate monitoring over events ---------------------------
@query("""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS events, round(sum(value), 6) AS value FROM events GROUP BY 1, 2""")
def crawl_rate(spark, d):
    rates = streams.crawl_rate(load(spark, d, "events"))
    return rates.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "events", F.round("value", 6).alias("value"))


@query("""WITH m AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE, true)::INT AS begins FROM events),
  s AS (SELECT user_id, ts, sum(begins) OVER (PARTITION BY user_id ORDER BY ts) AS visit FROM m)
  SELECT user_id, count(*) AS events, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS visit_start FROM s GROUP BY user_id, visit""")
def user_visits(spark, d):
    return streams.visits(load(spark, d, "events")).select("user_id", "events", F.date_format("visit_start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("visit_start"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked full-text search over the pages: title, host and score of the best
    matches of a boolean query with a prefix."""
    store = load(spark, sf_dir, "indexed_pages")
    rows, _ = search.search(store, *_index(spark, sf_dir, stem=True), "telescope OR vaccine OR season")
    return rows

