"""Classification: screenshots by rule, examples by votes, prototypes by softmax."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.constants import LEARN_SIMILARITY, MIN_CONFIDENCE, OCR_DOC_BOOST, OCR_DOC_CHARS, REASON_AI, REASON_LEARNED, TEMPERATURE, UNSORTED
from strata.functions.vectors import dot, mean_vectors
from strata.operators.neighbours import nearest_examples
from strata.sources.shared import written

MOST_CATEGORIES = 4_096


def prototypes(descriptions: DataFrame) -> DataFrame:
    """(name, vec): the normalised mean of each category's description vectors."""
    return mean_vectors(descriptions, ["name"], "vec")


def learned(items: DataFrame, examples: DataFrame, names: list[str], threshold: float = LEARN_SIMILARITY, most: int = 5) -> DataFrame:
    """(id, category, confidence) by the votes of the most similar corrected files, each voting with its similarity.

    Examples are what users corrected by hand. The votes are counted inside each item's row.
    """
    known = examples.where(F.col("corrected") & ~F.col("removed") & F.col("vec").isNotNull() & F.col("category").isin(names)).select("id", F.col("category").alias("label"), "vec")
    near = nearest_examples(items, known, most, threshold)
    of = lambda c: F.filter("top", lambda t: t["label"] == c)
    votes = lambda c: F.aggregate(F.filter(of(c), lambda t: t["sim"] >= threshold), F.lit(0.0), lambda a, t: a + t["sim"])
    best = lambda c: F.array_max(F.transform(of(c), lambda t: t["sim"]))
    place = lambda c: F.array_position(F.transform("top", lambda t: t["label"]), c)
    labels = F.array_distinct(F.transform("top", lambda t: t["label"]))
    ranked = F.transform(F.filter(labels, lambda c: best(c) >= threshold), lambda c: F.struct(votes(c).alias("v"), (-place(c)).alias("f"), c.alias("c"), best(c).alias("b")))
    won = near.select("id", F.array_max(ranked).alias("m")).where("m is not null")
    return won.select("id", F.col("m.c").alias("category"), F.col("m.b").alias("confidence"))


def zero_shot(items: DataFrame, protos: DataFrame, screenshot: str = "", document: str = "", temperature: float = TEMPERATURE, least: float = MIN_CONFIDENCE) -> DataFrame:
    """(id, category, confidence, second, second_score): softmax over the prototypes; below ``least`` it is unsorted and the winner is second.

    Categories are a user's short list, MOST_CATEGORIES at most (checked); they travel in one row, and each
    item is judged inside its own.
    """
    listed = written(protos.select("name", "vec"))
    if listed.count() > MOST_CATEGORIES:
        raise ValueError(f"more than {MOST_CATEGORIES} categories")
    one = listed.agg(F.sort_array(F.collect_list(F.struct("name", "vec"))).alias("protos"))
    photo = (F.col("camera") | (F.col("kind") == "video"))
    wordy = (F.col("kind") == "image") & (F.col("text_len") >= OCR_DOC_CHARS)

    def similarity(p: Column) -> Column:
        masked = F.when(photo & (p["name"] == screenshot), F.lit(-1.0)).otherwise(dot(F.col("vec"), p["vec"]))
        return masked + F.when(wordy & (p["name"] == document), F.lit(OCR_DOC_BOOST)).otherwise(F.lit(0.0))

    scored = items.select("id", "vec", "kind", "camera", "text_len").crossJoin(F.broadcast(one))  # one row
    scored = scored.select("id", F.transform("protos", lambda p: F.struct(p["name"].alias("name"), similarity(p).alias("s"))).alias("s")).where(F.size("s") > 0)
    scored = scored.withColumn("top", F.array_max(F.transform("s", lambda x: x["s"])))
    scored = scored.withColumn("e", F.transform("s", lambda x: F.struct((-F.exp((x["s"] - F.col("top")) * temperature)).alias("e"), x["name"].alias("name"))))
    scored = scored.withColumn("all", F.aggregate("e", F.lit(0.0), lambda a, x: a - x["e"])).withColumn("e", F.sort_array("e"))
    first, second = F.col("e")[0], F.try_element_at("e", F.lit(2))
    two = scored.select("id", first["name"].alias("a"), (-first["e"] / F.col("all")).alias("pa"), second["name"].alias("b"), (-second["e"] / F.col("all")).alias("pb"))
    low = F.col("pa") < least
    return two.select("id", F.when(low, UNSORTED).otherwise(F.col("a")).alias("category"), F.col("pa").alias("confidence"), F.when(low, F.col("a")).otherwise(F.col("b")).alias("second"), F.when(low, F.col("pa")).otherwise(F.col("pb")).alias("second_score"))


def cascade(items: DataFrame, examples: DataFrame, protos: DataFrame, names: list[str], dim: int, screenshot: str = "", document: str = "", vote: float | None = None) -> DataFrame:
    """(id, category, confidence, reason, second, second_score): another dimension, then the screenshot rule (column shot), then examples, then prototypes."""
    fit = items.where(F.size("vec") == dim)
    rest = fit.where(F.col("shot").isNull()) if screenshot in names else fit
    voted = learned(rest, examples, names, LEARN_SIMILARITY if vote is None else vote)
    shown = zero_shot(rest, protos, screenshot, document)
    out = items.select("id", (F.size("vec") != dim).alias("odd"), "shot").join(voted.select("id", F.col("category").alias("vc"), F.col("confidence").alias("vs")), "id", "left").join(shown, "id", "left")
    is_shot = F.col("shot").isNotNull() & F.lit(screenshot in names)
    pick = lambda odd, shot, vote, else_: F.when(F.col("odd"), odd).when(is_shot, shot).when(F.col("vc").isNotNull(), vote).otherwise(else_)
    none = F.lit(None)
    unsure = F.when(F.col("category") == UNSORTED, F.concat(F.lit("最像「"), "second", F.lit("」但不夠確定"))).otherwise(F.lit(REASON_AI))
    return out.select(
        "id", pick(F.lit(UNSORTED), F.lit(screenshot), F.col("vc"), F.col("category")).alias("category"), pick(none.cast("double"), F.lit(1.0), F.col("vs"), F.col("confidence")).alias("confidence"),
        pick(F.lit("索引需要重建"), F.col("shot"), F.lit(REASON_LEARNED), unsure).alias("reason"), pick(none.cast("string"), none.cast("string"), none.cast("string"), F.col("second")).alias("second"),
        pick(none.cast("double"), none.cast("double"), none.cast("double"), F.col("second_score")).alias("second_score"),
    )
