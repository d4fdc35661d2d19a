"""Matching of bidders by tax id and by the words of their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import plain

# Company forms and empty words that tell no bidder from another, and the least letters of a term.
EMPTY = "a al de del e el en la las lo los y sa srl sas sociedad anonima responsabilidad limitada cia compania hnos hijos".split()
LEAST_TERM = 3


def terms(name: Column) -> Column:
    """The distinct words of a name that tell it from others, sorted."""
    words = F.regexp_extract_all(F.regexp_replace(plain(name), r"[.]", ""), F.lit(r"([a-z0-9]+)"), 1)
    return F.sort_array(F.array_distinct(F.filter(words, lambda w: (F.length(w) >= LEAST_TERM) & ~w.isin(EMPTY))))


def matched_offers(portal: DataFrame, loaded: DataFrame, by: str) -> DataFrame:
    """portal (by, portal_id, tax_id, name) with the loaded offer (by, offer_id, tax_id or null, name) that it is: offer_id, how.

    how: tax_id; name (the same terms, else all terms of the loaded name, one candidate only); ambiguous; other_tax_id (a name fits
    but has another tax id); none. Names meet through the loaded name's first term, so no group's names are all paired.
    """
    p = portal.select(by, "portal_id", F.col("tax_id").alias("__tax"), terms(F.col("name")).alias("__p"))
    own = loaded.select(by, "offer_id", F.col("tax_id").alias("__own"), terms(F.col("name")).alias("__o"))
    by_tax = p.join(own.where("__own IS NOT NULL").groupBy(by, F.col("__own").alias("__tax")).agg(F.min("offer_id").alias("__t")), [by, "__tax"])
    by_tax = by_tax.select(by, "portal_id", "__t")
    spread = p.select(by, "portal_id", "__p", F.explode("__p").alias("__w"))
    met = spread.join(own.where(F.size("__o") > 0).withColumn("__w", F.col("__o")[0]), [by, "__w"]).where(F.size(F.array_except("__o", "__p")) == 0)
    free, exact = F.col("__own").isNull(), F.col("__o") == F.col("__p")
    found = met.groupBy(by, "portal_id").agg(
        F.count_if(free & exact).alias("__e"), F.min(F.when(free & exact, F.col("offer_id"))).alias("__eid"),
        F.count_if(free & ~exact).alias("__s"), F.min(F.when(free & ~exact, F.col("offer_id"))).alias("__sid"), F.count_if(~free).alias("__x"),
    )
    out = p.select(by, "portal_id").join(by_tax, [by, "portal_id"], "left").join(found, [by, "portal_id"], "left")
    e, s = F.coalesce("__e", F.lit(0)), F.coalesce("__s", F.lit(0))
    how = (
        F.when(F.col("__t").isNotNull(), "tax_id").when(e == 1, "name").when(e > 1, "ambiguous").when(s == 1, "name").when(s > 1, "ambiguous")
        .when(F.coalesce("__x", F.lit(0)) > 0, "other_tax_id").otherwise("none")
    )
    offer = F.coalesce("__t", F.when(e == 1, F.col("__eid")).when((e == 0) & (s == 1), F.col("__sid")))
    return out.select(by, "portal_id", offer.alias("offer_id"), how.alias("how"))
