"""SpotSigs fingerprints, in DataFrame functions alone.

A spot is a common word (an anchor); its signature is the anchor with the next ``chain`` content words,
other anchors left out.  The distinct signatures of a text, as sorted 32-bit hashes, are its fingerprint.
Boilerplate has few anchors, running text has many, so the set follows the text and not its frame.

A text is cut once into runs of anchors, each with the content word that ends it, so that the words after an
anchor are looked up by position: the work follows the length of the text, whatever it repeats.

Two sets with Jaccard similarity of at least t have sizes within a factor t, so sets are partitioned by
length: partition ``floor(log(size) / log(1 / t))``, and only equal or adjacent partitions can
match.  ``likeness`` compares two sets; ``similar`` joins a table of sets through the partitions
and the signatures that a matching pair cannot avoid sharing, the rarest of each set.

Anchors come from the commonest words of the languages at hand.  A text without spots (too short,
or without anchors) takes its words as signatures.

Defined results: a null text is an empty one, with an empty set and the fingerprint ``''``; two empty
sets have likeness 1; rows with a null doc_id come last in the order; these and rows with equal doc_ids are
ordered by their texts' hashes; the only row of a table is its own next; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from learnlens.llm.shared import Scratch, width

# Common words of English, German, French and Spanish.  Fixed values.
ANCHORS = (
    "the of and to a in is that it was for on are with as be at by this from an or he not "
    "der die das und ist nicht von zu mit sich auf für den ein eine im "
    "le la les de des du un une et est que qui pour dans pas au avec par sur "
    "el los y en por con del se su para es lo como al más"
).split()


def _tree(words: list[str]) -> str:
    """One pattern for all words, by their first letters, so that a miss is found early."""
    tails: dict[str, list[str]] = defaultdict(list)
    for word in words:
        tails[word[0]].append(word[1:])
    parts = []
    for first, rest in sorted(tails.items()):
        longest_first = sorted(set(rest), key=lambda w: (-len(w), w))
        parts.append(f"{first}(?:{'|'.join(longest_first)})")
    return f"(?:{'|'.join(parts)})"


def words_of(text: Column) -> Column:
    """Words in lower case, a space before and after each."""
    return F.concat(
        F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), F.lit(" ")
    )


def _let(value: Column, body) -> Column:
    """``body(value)``, the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def signatures(text: Column, chain: int = 2, anchors: list[str] | tuple = ANCHORS) -> Column:
    """The distinct signatures of a text, sorted."""
    # runs of anchors, each with the word that ends it; a full stop ends the last
    runs = F.regexp_extract_all(
        F.concat(F.trim(words_of(text)), F.lit(" . ")), F.lit(rf"(?:{_tree(list(anchors))} )*+[^ ]+ "), F.lit(0)
    )

    def all_of(runs: Column) -> Column:
        words = F.transform(runs, lambda run: F.substring_index(F.rtrim(run), " ", -1))
        return _let(words, lambda words: spots_of(runs, words))

    def spots_of(runs: Column, words: Column) -> Column:
        whole = F.greatest(F.size(words) - chain, F.lit(0))  # runs with enough words behind them

        def of_run(run: Column, place: Column) -> Column:
            after = [F.get(words, place + i) for i in range(chain)]
            parts = F.split(F.rtrim(run), " ")
            own = F.array_distinct(F.slice(parts, F.lit(1), F.size(parts) - 1))
            return F.transform(own, lambda anchor: F.hash(F.concat_ws(" ", anchor, *after)))

        return F.flatten(F.transform(F.slice(runs, F.lit(1), whole), of_run))

    def chosen(runs: Column) -> Column:
        plain = F.filter(F.split(F.concat_ws("", runs), " "), lambda word: (word != "") & (word != "."))
        return _let(
            all_of(runs),
            lambda spots: F.when(F.size(spots) > 0, spots).otherwise(F.transform(plain, lambda word: F.hash(word))),
        )

    return F.array_sort(F.array_distinct(_let(runs, chosen)))


def fingerprint(sigs: Column) -> Column:
    return F.array_join(sigs.cast("array<string>"), " ")


def length_partition(sigs: Column, threshold: float) -> Column:
    return F.floor(F.log(F.greatest(F.size(sigs), F.lit(1)).cast("double")) / F.lit(log(1 / threshold)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def similar(sets: DataFrame, threshold: float = 0.8, tile: int = 1000) -> DataFrame:
    """``(a, b, likeness)``: pairs of rows ``(id, sigs)`` with different sets and at least this
    likeness, ``a < b``.

    Equal sets count once, by their smallest id.  A set of n signatures shares at least one of any
    ``n - ceil(t * n) + 1`` of its own with every match; the rarest ones are taken, and these alone are joined,
    within a length partition and to the next.  A signature that more than ``tile`` sets have taken is cut into
    tiles, each joined with all others.
    """
    one = sets.filter(F.size("sigs") > 0).groupBy("sigs").agg(F.min("id").alias("id"))
    spread = one.select("id", F.explode("sigs").alias("sig"))
    rarity = spread.groupBy("sig").agg(F.count("*").alias("n"))
    taken = F.col("size") - F.ceil(F.col("size") * threshold).cast("int") + 1
    ordered = spread.join(rarity, "sig").groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("n", "sig"))).alias("rare"), F.count("*").cast("int").alias("size")
    )
    prefix = ordered.select("id", F.explode(F.slice("rare.sig", F.lit(1), taken)).alias("sig"))
    tiles = prefix.groupBy("sig").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    part = length_partition(F.col("sigs"), threshold)
    entries = prefix.join(tiles, "sig").join(one.select("id", "sigs", part.alias("part")), "id")
    left = entries.withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")).drop("tiles")
    right = entries.select(
        F.col("id").alias("id2"), F.col("sigs").alias("sigs2"), F.col("sig").alias("sig2"), F.col("part").alias("part2"),
        F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile2"),
    )
    right = right.select("*", F.explode(F.array(F.col("part2"), F.col("part2") - 1)).alias("part3"))
    smaller, larger = F.least(F.size("sigs"), F.size("sigs2")), F.greatest(F.size("sigs"), F.size("sigs2"))
    once = (F.col("part") < F.col("part2")) | (F.col("id") < F.col("id2"))
    same = (F.col("sig") == F.col("sig2")) & (F.col("part") == F.col("part3")) & (F.col("tile") == F.col("tile2"))
    near = (
        left.join(right, same)
        .filter((F.col("id") != F.col("id2")) & once & (smaller >= larger * threshold))
        .withColumn("likeness", likeness(F.col("sigs"), F.col("sigs2")))
        .filter(F.col("likeness") >= threshold)
    )
    return near.select(
        F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"), "likeness"
    ).distinct()


def edited_pairs(documents: DataFrame, scratch: Scratch, threshold: float = 0.8) -> DataFrame:
    """Every text with an edited form of it and the next text, in descending doc_id order."""
    parts = width(documents.sparkSession)
    shares = [i / parts for i in range(1, parts)]
    edges = documents.select(F.percentile_approx("doc_id", shares, 10_000).alias("e")).first()["e"]
    edges = sorted(set(edges or []))
    # ids in ranges; the ranges are sorted apart from each other, and their first rows passed on
    bounds = F.array(*map(F.lit, edges)) if edges else F.array().cast("array<bigint>")
    order = [F.desc_nulls_last("doc_id"), F.desc("tie")]
    tied = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    tied = tied.withColumn("tie", F.xxhash64("text"))
    # rows without an id come behind the others, in ranges of their own
    share = F.floor((F.col("tie") / 2.0**64 + 0.5) * parts).cast("int")
    last = F.least(F.greatest(share, F.lit(0)), F.lit(parts - 1)) - parts
    rank = F.when(F.col("doc_id").isNull(), last).otherwise(F.size(F.filter(bounds, lambda e: e <= F.col("doc_id"))))
    tied = tied.withColumn("part", rank)
    first = F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("d"), "tie")
    heads = tied.groupBy("part").agg(F.max_by("text", first).alias("head"))
    heads = scratch.stage(heads, "heads")
    # a row per range: the head of the next lower one, around to the highest
    down = Window.orderBy(F.desc("part"))
    everything = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = heads.select(
        "part", F.coalesce(F.lead("head").over(down), F.first("head").over(everything)).alias("head")
    )

    signed = tied.withColumn("sigs", signatures(F.col("text")))
    within = Window.partitionBy("part").orderBy(*order)
    moved = signed.withColumns(
        {"next_text": F.lead("text").over(within), "next_sigs": F.lead("sigs").over(within)}
    )
    whole = moved.join(scratch.stage(after.withColumn("head_sigs", signatures(F.col("head"))), "after"), "part")
    next_text = F.coalesce("next_text", "head")
    next_sigs = F.when(F.col("next_text").isNull(), F.col("head_sigs")).otherwise(F.col("next_sigs"))
    n_chars = F.char_length("text")
    half = F.floor(n_chars / 2).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), n_chars - half), F.substring(next_text, F.lit(1), half)
    )
    # a generator, so that the edited text is made once and not in each expression over it
    made = whole.select(
        "doc_id",
        n_chars.cast("long").alias("n_chars"),
        "sigs",
        next_sigs.alias("next_sigs"),
        F.explode(F.array(edited)).alias("edited"),
    )
    made = made.select("*", F.explode(F.array(signatures(F.col("edited")))).alias("edited_sigs"))
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
        F.size("sigs").alias("n_signatures"),
        length_partition(F.col("sigs"), threshold).alias("length_partition"),
    )
