"""Sitemaps: parsing, expansion of indexes, seeding."""

from __future__ import annotations

import gzip
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import staged
from ..schemas import SITEMAP_ENTRY

# --- fixed values
WELL_KNOWN = ["/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/sitemaps.xml"]
MOST_DEPTH, SEED_SITEMAPS, SEED_URLS = 3, 5, 1000
# --- end of fixed values

_LOC = re.compile(r"<loc>\s*([^<]+)\s*</loc>", re.I)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def parse_sitemap(content: bytes | str | None) -> list[dict]:
    """Entries of one sitemap, kind `url` or `sitemap`.  Compressed content is
    unpacked, name spaces are ignored, of malformed XML the addresses are kept.
    Entries read before an unusable value stay."""
    if not content:
        return []
    if isinstance(content, str):
        content = content.encode("latin-1" if content.startswith("\x1f\x8b") else "utf-8", "replace")
    try:
        if content[:2] == b"\x1f\x8b":
            content = gzip.decompress(content)
    except (OSError, EOFError):
        return []
    out: list[dict] = []
    try:
        root = ET.fromstring(content)
    except ET.ParseError:
        found = (m.group(1).strip() for m in _LOC.finditer(content.decode("utf-8", "replace")))
        return [{"kind": "url", "loc": loc} for loc in found if loc.startswith("http")]
    wanted = {"sitemap": "sitemap"} if _local(root.tag) == "sitemapindex" else {}
    for element in root.iter():
        kind = {"url": "url", **wanted}.get(_local(element.tag))
        if kind is None or element is root:
            continue
        fields = {_local(c.tag): c.text.strip() for c in element if c.text and c.text.strip()}
        if "loc" not in fields:
            continue
        entry = {"kind": kind, "loc": fields["loc"]}
        if kind == "url":
            entry |= {k: fields.get(k) for k in ("lastmod", "changefreq")}
            if "priority" in fields:
                try:
                    entry["priority"] = float(fields["priority"])
                except ValueError:
                    break
        out.append(entry)
    return out


_ENTRY = pa.schema([("sitemap_url", pa.string()), ("kind", pa.string()), ("loc", pa.string()), ("lastmod", pa.string()), ("changefreq", pa.string()), ("priority", pa.float64())])


def parse_sitemaps(files: DataFrame) -> DataFrame:
    """Entries of `files` (sitemap_url, content as string or binary)."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"sitemap_url": u} | e for u, c in zip(*(x.to_pylist() for x in batch.columns)) for e in parse_sitemap(c)]
            yield pa.RecordBatch.from_pylist(rows, schema=_ENTRY)

    return files.select("sitemap_url", "content").mapInArrow(parse, SITEMAP_ENTRY)


def expand_sitemaps(files: DataFrame, starts: DataFrame, most_depth: int = MOST_DEPTH) -> DataFrame:
    """(start, level, loc, lastmod, changefreq, priority): the addresses that the
    sitemaps `starts` (sitemap_url) lead to, through indexes up to `most_depth`
    levels below; each sitemap is visited once, so cycles end."""
    entries = staged(parse_sitemaps(files), "sitemap-entries")
    level = starts.select(F.col("sitemap_url").alias("start"), "sitemap_url").distinct()
    seen = level
    found = None
    for depth in range(most_depth + 1):
        level = staged(level, "sitemap-level")
        here = level.join(entries, "sitemap_url")
        urls = here.where("kind = 'url'").select("start", F.lit(depth).alias("level"), "loc", "lastmod", "changefreq", "priority")
        found = urls if found is None else found.unionByName(urls)
        below = here.where("kind = 'sitemap'").select("start", F.col("loc").alias("sitemap_url")).distinct()
        level = below.join(seen, ["start", "sitemap_url"], "left_anti")
        seen = seen.unionByName(level)
    return found


def discover(domains: DataFrame, declared: DataFrame, available: DataFrame) -> DataFrame:
    """(domain, sitemap_url, declared): sitemaps of `domains` (domain) - those
    robots files declare (domain, sitemap), and well-known places that answer,
    that is, are in `available` (sitemap_url)."""
    guesses = domains.select("domain", F.explode(F.array(*[F.concat(F.lit("https://"), F.col("domain"), F.lit(p)) for p in WELL_KNOWN])).alias("sitemap_url"))
    answering = guesses.join(available.select("sitemap_url").distinct(), "sitemap_url", "left_semi").select("domain", "sitemap_url", F.lit(False).alias("declared"))
    named = declared.join(domains.select("domain").distinct(), "domain", "left_semi").select("domain", F.col("sitemap").alias("sitemap_url"), F.lit(True).alias("declared"))
    return named.unionByName(answering).groupBy("domain", "sitemap_url").agg(F.max("declared").alias("declared"))


def seeds(expanded: DataFrame, most_sitemaps: int = SEED_SITEMAPS, most_urls: int = SEED_URLS) -> DataFrame:
    """Addresses a crawl begins with: of the first sitemaps, by address, the
    first addresses each."""
    order = expanded.select("start").distinct().orderBy("start").limit(most_sitemaps)
    chosen = expanded.join(F.broadcast(order), "start", "left_semi")  # at most most_sitemaps rows
    row = F.row_number().over(Window.partitionBy("start").orderBy("loc"))
    return chosen.withColumn("row", row).where(F.col("row") <= most_urls).select("start", F.col("loc").alias("url"), F.lit(1).alias("depth"), F.lit("HIGH").alias("priority"))
