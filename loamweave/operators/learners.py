"""Learned spellings: a dictionary from aligned names, words by sound, and the word a native one sounds like."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as nm
from ..functions import similarity as sim
from ..functions import text as tx


def aligned(pairs: DataFrame, least: float = 75) -> DataFrame:
    """(src, dst) words of aligned texts (a, b): by place where they have as many words, else the best by sound.

    A word meets all words of the other name only inside one pair; equal pairs of sounds are compared once.
    """
    d = pairs.withColumn("_row", F.monotonically_increasing_id()).withColumns({"x": tx.tokens(F.col("a")), "y": tx.tokens(F.col("b"))})
    even = d.filter(F.size("x") == F.size("y")).select(F.explode(F.arrays_zip("x", "y")).alias("z")).select(F.col("z.x").alias("src"), F.col("z.y").alias("dst"))
    odd = d.filter((F.size("x") != F.size("y")) & (F.size("x") > 0) & (F.size("y") > 0))
    odd = odd.select("_row", F.posexplode("x").alias("i", "src"), "y").select("_row", "i", "src", F.posexplode("y").alias("j", "dst"))
    odd = odd.withColumns({"s": nm.skeleton(F.col("src")), "t": nm.skeleton(F.col("dst"))})
    met = odd.select("s", "t").distinct().withColumn("score", sim.similarity(d.sparkSession, "ratio", F.col("s"), F.col("t")))
    best = odd.join(met, ["s", "t"]).groupBy("_row", "i", "src").agg(F.max_by(F.struct("dst", "score"), F.struct("score", -F.col("j"))).alias("m"))
    return even.unionByName(best.filter(F.col("m.score") >= least).select("src", F.col("m.dst").alias("dst")))


def dictionary(words: DataFrame, least: int = 3, share: float = 0.5) -> DataFrame:
    """(src, dst): the most frequent counterpart of a word, if it is seen often enough, has enough of its alignments and differs (ties: by name)."""
    n = words.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    top = n.groupBy("src").agg(F.sum("n").alias("total"), F.min_by(F.struct("dst", "n"), F.struct(-F.col("n"), "dst")).alias("m")).select("src", "total", "m.dst", "m.n")
    return top.filter((F.col("n") >= least) & (F.col("n") / F.col("total") >= share) & (F.col("src") != F.col("dst"))).select("src", "dst")


def sound_map(names: DataFrame, column: str = "name", least: int = 20, sounds: int = 3, keep: int = 8) -> DataFrame:
    """(skeleton, words): the frequent Latin words of each sound, the most frequent first (ties: by name)."""
    w = names.select(F.explode(tx.tokens(F.lower(column))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    w = w.filter((F.col("n") >= least) & (F.length("word") >= 3) & ~F.col("word").rlike("^[0-9]+$")).withColumn("skeleton", nm.skeleton(F.col("word")))
    w = w.filter(F.length("skeleton") >= sounds).withColumn("place", F.row_number().over(Window.partitionBy("skeleton").orderBy(F.desc("n"), "word"))).filter(F.col("place") <= keep)
    return w.groupBy("skeleton").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]).alias("words"))


def sound_alike(words: DataFrame, sounds: DataFrame, least: float = 58) -> DataFrame:
    """(word, alike) for distinct words: of the words of its sound the most similar one (ties: the later), else itself."""
    d = words.select("word").distinct()
    near = d.filter(F.length("word") > 4).withColumn("skeleton", nm.skeleton(F.col("word"))).join(sounds, "skeleton").select("word", F.posexplode("words").alias("i", "other"))
    share = F.length("other") / F.length("word")
    near = near.filter((F.length("other") >= 4) & F.col("other").rlike("[aeiou]") & (share >= 0.7) & (share <= 1.6))
    near = near.withColumn("score", sim.similarity(d.sparkSession, "ratio", F.col("word"), F.col("other"))).filter(F.col("score") >= least)
    best = near.groupBy("word").agg(F.max_by("other", F.struct("score", "i")).alias("alike"))
    return d.join(best, "word", "left").select("word", F.coalesce("alike", "word").alias("alike"))
