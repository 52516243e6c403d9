"""URL filters as a temporal list join, with DataFrame functions only.

Dated list entries (a category lists or delists a domain) become validity intervals: an entry holds from its time up
to the next entry of the same category and domain. An as-of join then evaluates every capture against the entries
that are active at its fetch time, for its host and all parent domains. The work is done once for each distinct host
and fetch time; those rows are salted against the list, so that a host with a third of all captures is no hot key.

Edge cases: null or malformed urls, and null fetch times, match nothing; entries without a domain, category or time
are ignored; of entries with equal category, domain and time, one that lists wins; repeated captures give repeated
rows; an empty list or table is fine; further columns pass through, and those with an output's name are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_SALTS = 16


def host_of(url):
    """The lower-case host of a url, or ''."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def validity(entries: DataFrame) -> DataFrame:
    """(category, domain, valid_from, valid_to) of the listed times; valid_to is exclusive, null while open."""
    known = entries.where("category IS NOT NULL AND domain IS NOT NULL AND at IS NOT NULL")
    known = known.groupBy("category", F.lower("domain").alias("domain"), "at").agg(F.max(F.coalesce("listed", F.lit(True))).alias("listed"))
    following = F.lead("at").over(W.partitionBy("category", "domain").orderBy("at"))
    return known.withColumn("valid_to", following).where("listed").select("category", "domain", F.col("at").alias("valid_from"), "valid_to")


def filter_urls(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """`captures` with host, categories (sorted, of the entries active at the fetch time) and blocked."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))
    intervals = validity(entries).withColumn("salt", salts)
    rows = captures.withColumn("host", host_of(F.col(url)))
    times = rows.where(F.col(fetched).isNotNull() & (F.col("host") != "")).groupBy("host", F.col(fetched).alias("_at")).agg(F.lit(1).alias("one"))
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keys = times.select("host", "_at", F.explode(parents).alias("domain")).withColumn("salt", F.pmod(F.xxhash64("host", "_at"), F.lit(_SALTS)).cast("int"))
    active = keys.join(intervals, ["domain", "salt"]).where((F.col("_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("_at") < F.col("valid_to"))))
    found = active.groupBy("host", "_at").agg(F.sort_array(F.collect_set("category")).alias("_categories"))
    out = rows.alias("c").join(found.alias("f"), F.expr(f"c.host = f.host AND c.`{fetched}` = f._at"), "left")
    kept = [F.col(f"c.`{c}`") for c in captures.columns if c not in ("host", "categories", "blocked")]
    categories = F.coalesce("f._categories", F.array().cast("array<string>"))
    return out.select(*kept, "c.host", categories.alias("categories"), (F.size(categories) > 0).alias("blocked"))
