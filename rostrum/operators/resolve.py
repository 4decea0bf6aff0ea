"""Entity matching: blocks, token overlap, tie-breaks and elimination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import written


def name_tokens(name: Column) -> Column:
    """Upper-case letter tokens of a name; hyphens part words."""
    clean = F.regexp_replace(F.upper(F.translate(name, "-‐’", "  '")), "[^A-Z ]", "")
    return F.filter(F.split(clean, " +"), lambda t: t != "")


def candidates(units: DataFrame, persons: DataFrame, block: list[str], unit_name: str, person_name: str) -> DataFrame:
    """Pairs of the same block whose names share a token: an equi-join on (block, token), never all pairs of a block."""
    left = units.withColumn("__t", F.explode(F.array_distinct(name_tokens(F.col(unit_name)))))
    right = persons.withColumn("__t", F.explode(F.array_distinct(name_tokens(F.col(person_name)))))
    return left.join(right, [*block, "__t"]).drop("__t").distinct()


def resolved(pairs: DataFrame, unit: str, person: str, prefer: Column) -> DataFrame:
    """One row for each unit: its single candidate, else the single preferred one, else null with the reason."""
    per = pairs.groupBy(unit).agg(
        F.count_distinct(person).alias("n_candidates"), F.min(person).alias("__any"),
        F.count_distinct(F.when(prefer, F.col(person))).alias("__n"), F.min(F.when(prefer, F.col(person))).alias("__p"),
    )
    match = F.when(F.col("n_candidates") == 1, F.col("__any")).when(F.col("__n") == 1, F.col("__p"))
    how = F.when(F.col("n_candidates") == 1, "unique").when(F.col("__n") == 1, "tie_break").otherwise("ambiguous")
    return per.select(unit, match.alias(person), how.alias("resolved_by"), "n_candidates")


def resolved_near(units: DataFrame, persons: DataFrame, block: str, unit: str, person: str, unit_value: str, person_value: str, radius: float) -> DataFrame:
    """What `resolved` returns for all pairs of a block where values less than `radius` apart are preferred, without the pairs.

    Candidates are counted for each set of blocks that a unit has, so persons of several blocks count
    once. Whether one person alone is near is told by the nearest value on either side of the unit's
    and the nearest one beyond it that another person has: windows over the sorted values of a block.
    """
    persons = persons.select(F.col(block).alias("__b"), F.col(person).alias("__p"), F.col(person_value).alias("__v")).filter("__b is not null")
    units = units.select(F.col(block).alias("__b"), F.col(unit).alias("__u"), F.col(unit_value).alias("__v")).filter("__b is not null")

    sets = persons.groupBy("__p").agg(F.sort_array(F.collect_set("__b")).alias("__t")).groupBy("__t").agg(F.count("__p").alias("__k"), F.min("__p").alias("__any"))
    homes = units.groupBy("__u").agg(F.sort_array(F.collect_set("__b")).alias("__s"))
    met = homes.select("__s").distinct().withColumn("__b", F.explode("__s")).join(sets.withColumn("__b", F.explode("__t")), "__b")
    counts = met.drop("__b").distinct().groupBy("__s").agg(F.sum("__k").alias("n_candidates"), F.min("__any").alias("__any"))

    # one row for each value of a block: its least and largest person
    values = persons.filter("__p is not null and __v is not null").groupBy("__b", "__v").agg(F.min("__p").alias("__low"), F.max("__p").alias("__high"))
    rows = values.withColumn("__u", F.lit(None).cast(units.schema["__u"].dataType)).withColumn("__asks", F.lit(False)).unionByName(units.distinct().withColumn("__asks", F.lit(True)), allowMissingColumns=True)
    at = F.when(~F.col("__asks"), F.struct("__v", "__low", "__high"))
    for side, order in (("below", F.asc("__v")), ("above", F.desc("__v"))):
        w = Window.partitionBy("__b").orderBy(order, "__asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        before = F.last(at, True).over(Window.partitionBy("__b").orderBy(order, "__asks").rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.withColumn("__near", before)
        # the nearest value, this one included, of another person than this value's least; null where it is that of the value before
        new = F.when(F.col("__low") != F.col("__high"), F.col("__v")).when((F.col("__near.__low") != F.col("__low")) | (F.col("__near.__high") != F.col("__low")), F.col("__near.__v"))
        rows = rows.withColumn("__new", F.when(~F.col("__asks"), new)).withColumn(f"__{side}_next", F.last("__new", True).over(w)).withColumnRenamed("__near", f"__{side}").drop("__new")
    asked = rows.filter("__asks")

    def near(value):
        return F.abs(F.col("__v") - F.col(value)) < radius

    sides = ("__below", "__above")
    found = [F.when(near(f"{s}.__v"), F.col(f"{s}.__low")) for s in sides]
    more = [F.coalesce(near(f"{s}_next") & near(f"{s}.__v"), F.lit(False)) for s in sides]
    per = asked.groupBy("__u").agg(F.min(F.least(*found)).alias("__least"), F.max(F.greatest(*found)).alias("__most"), F.max(more[0] | more[1]).alias("__more"))
    one = (F.col("__least") == F.col("__most")) & ~F.col("__more")

    out = homes.join(counts, "__s").join(per.withColumnRenamed("__u", "__w"), F.col("__u").eqNullSafe(F.col("__w")))
    match = F.when(F.col("n_candidates") == 1, F.col("__any")).when(one, F.col("__least"))
    how = F.when(F.col("n_candidates") == 1, "unique").when(one, "tie_break").otherwise("ambiguous")
    return out.select(F.col("__u").alias(unit), match.alias(person), how.alias("resolved_by"), "n_candidates")


def eliminate(pairs: DataFrame, unit: str, person: str, seat: list[str]) -> DataFrame:
    """(unit, person, round): fixpoint of assigning units whose only free candidate no other such unit of the seat wants.

    Each round is written to the shared folder; the number of rounds is at most the largest number
    of candidates of a seat.
    """
    done, left, number = None, pairs.select(*seat, unit, person).distinct(), 0
    while True:
        number += 1
        size = F.count(F.lit(1)).over(Window.partitionBy(*seat, unit))
        single = left.withColumn("__n", size).filter("__n = 1").drop("__n")
        wanted = F.count(F.lit(1)).over(Window.partitionBy(*seat, person))
        new = single.withColumn("__w", wanted).filter("__w = 1").drop("__w").withColumn("round", F.lit(number))
        new = written(new, "eliminated")
        if new.isEmpty():
            return done if done is not None else new.select(*seat, unit, person, "round")
        done = new if done is None else done.unionByName(new)
        left = written(left.join(new.select(*seat, unit), [*seat, unit], "left_anti").join(new.select(*seat, person), [*seat, person], "left_anti"), "left-over")


def first_suffix(name: Column) -> Column:
    """Candidate (surname, given names) splits of a spoken name, longest surname first: array of structs with place."""
    tokens = name_tokens(name)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens), F.lit(1))), lambda i: F.struct(i.alias("place"), F.array_join(F.slice(tokens, i, F.size(tokens)), " ").alias("last"), F.array_join(F.slice(tokens, F.lit(1), i - 1), " ").alias("first")))


def resolve_speaker(rows: DataFrame, terms: DataFrame, name: str, block: list[str], at: str, state: str) -> DataFrame:
    """Match spoken names to terms (last, firsts array, state, start, end, person, block columns).

    For each row the longest surname that some term in force has decides; a given-name split needs
    the first name among the term's. A state that differs vetoes. Result: person, status
    (matched, no_candidate, ambiguous, state_mismatch).
    """
    # what is found depends on these columns alone, so rows need no number of their own
    asked = list(dict.fromkeys([name, *block, at, state]))
    keyed = rows.select(*asked).distinct()
    split = keyed.withColumn("__s", F.explode(first_suffix(F.col(name)))).withColumn("__last", F.col("__s.last")).withColumn("__first", F.element_at(F.split("__s.first", " "), 1)).withColumn("__place", F.col("__s.place"))
    own = terms.select(*block, F.col("last").alias("__last"), "firsts", F.col("state").alias("__state"), F.col("start").alias("__start"), F.col("end").alias("__end"), F.col("person").alias("__person"))
    near = split.join(own, [*block, "__last"]).filter((F.col(at) >= F.col("__start")) & (F.col(at) <= F.col("__end")) & ((F.col("__place") == 1) | F.array_contains("firsts", F.col("__first"))))
    agrees = F.col(state).isNull() | F.col("__state").isNull() | (F.col(state) == F.col("__state"))
    people = near.groupBy(*asked, "__place").agg(F.count_distinct("__person").alias("__n"), F.count_distinct(F.when(agrees, F.col("__person"))).alias("__m"), F.min(F.when(agrees, F.col("__person"))).alias("__p"))
    found = people.groupBy(*asked).agg(F.min_by(F.struct("__n", "__m", "__p"), "__place").alias("__f")).select(*[F.col(c).alias(f"__k_{c}") for c in asked], "__f")
    same = [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in asked]
    out = rows.join(found, same, "left").drop(*[f"__k_{c}" for c in asked])
    status = F.when(F.col("__f").isNull(), "no_candidate").when(F.col("__f.__m") == 0, "state_mismatch").when(F.col("__f.__m") > 1, "ambiguous").otherwise("matched")
    return out.withColumn("status", status).withColumn("person", F.when(F.col("status") == "matched", F.col("__f.__p"))).drop("__f")
