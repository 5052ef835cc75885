"""Files that have been moved on: chains of verified mappings, and the rules that a mapping must keep."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.storage import materialize


def _single(mappings: DataFrame, column: str) -> DataFrame:
    return mappings.groupBy(column).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select(column)


def follow(step: DataFrame) -> DataFrame:
    """(at, h, to, d, ends) from steps (at, h, to), each the only one of its (at, h): the last place that a chain reaches and how many steps
    that takes, or, with ends false, any place on a chain that never ends.

    Pointers are doubled, each round written. After k rounds all places within 2**k steps of an end know it; a round in which no place
    learns its end means that the rest lies on cycles or leads to one, for a longer chain has places at every distance from its end.
    """
    last = step.select("at", "h").withColumn("_goes", F.lit(True))

    def mark(df: DataFrame) -> DataFrame:
        there = last.select(F.col("at").alias("_a"), F.col("h").alias("_h"), "_goes")
        j = df.join(there, (F.col("to") == F.col("_a")) & (F.col("h") == F.col("_h")), "left")
        return j.select("at", "h", "to", "d", F.col("_goes").isNull().alias("ends"))

    now = materialize(mark(step.withColumn("d", F.lit(1).cast("bigint"))), "chains")
    open_before = None
    while True:
        still = now.where("not ends").count()
        if not still or still == open_before:
            return now
        open_before = still
        ahead = now.select(F.col("at").alias("_a"), F.col("h").alias("_h"), F.col("to").alias("_t"), F.col("d").alias("_d"), F.col("ends").alias("_e"))
        on = now.where("not ends").join(ahead, (F.col("to") == F.col("_a")) & (F.col("h") == F.col("_h")))
        moved = on.select("at", "h", F.col("_t").alias("to"), (F.col("d") + F.col("_d")).alias("d"), F.col("_e").alias("ends"))
        now = materialize(now.where("ends").unionByName(moved), "chains")


def resolve_chain(prior: DataFrame, mappings: DataFrame, inventory: DataFrame) -> DataFrame:
    """(path, final, hops, state) for files of prior (path, hash), followed along mappings (src, dst, hash, verified) to inventory (path, hash).

    present: the file is where it was. excused: a chain of verified mappings, each the only one of its source and of its destination, all bound to the
    file's hash, ends at a file of the inventory with that hash. cycle: the chain never ends; final and hops are null. Else missing.
    """
    ok = mappings.where(F.col("verified") & F.col("hash").isNotNull() & ~F.col("dst").cast("string").contains(".."))
    one = ok.join(_single(mappings, "src"), "src", "left_semi").join(_single(mappings, "dst"), "dst", "left_semi")
    reach = follow(one.select(F.col("src").alias("at"), F.col("hash").alias("h"), F.col("dst").alias("to")))
    there = inventory.select(F.col("path").alias("p"), F.col("hash").alias("i")).distinct()
    here = inventory.select(F.col("path").alias("p0")).distinct()
    j = prior.select("path", "hash").join(reach, (F.col("path") == F.col("at")) & (F.col("hash") == F.col("h")), "left")
    j = j.withColumn("final", F.coalesce("to", "path"))
    out = j.join(there, (F.col("final") == F.col("p")) & (F.col("hash") == F.col("i")), "left").join(here, F.col("path") == F.col("p0"), "left")
    stays, turns = F.col("p0").isNotNull(), ~F.coalesce("ends", F.lit(True))
    state = F.when(stays, "present").when(turns, "cycle").when(F.col("d").isNotNull() & F.col("p").isNotNull(), "excused").otherwise("missing")
    final = F.when(stays, F.col("path")).when(~turns, F.col("final"))
    hops = F.when(stays, 0).when(~turns, F.coalesce("d", F.lit(0))).cast("bigint")
    return out.select("path", final.alias("final"), hops.alias("hops"), state.alias("state"))


REQUIRED = ["prior_move", "prior_destination", "prior_path", "successor_manifest", "successor_move", "successor_source", "successor_destination", "size", "sha"]
#: The rules in the order in which their names are given.
RULES = [
    "FIELD_MISSING",
    "PATH_ESCAPE",
    "PRIOR_MOVE_UNKNOWN",
    "PRIOR_DESTINATION",
    "PRIOR_FILE_UNKNOWN",
    "PRIOR_HASH_MISSING",
    "PRIOR_SIZE",
    "PRIOR_SHA256",
    "SUCCESSOR_SOURCE",
    "SUCCESSOR_MANIFEST_UNKNOWN",
    "SUCCESSOR_MOVE_UNKNOWN",
    "SUCCESSOR_NOT_VERIFIED",
    "SUCCESSOR_ROW_SOURCE",
    "SUCCESSOR_ROW_DESTINATION",
    "SUCCESSOR_PRE_HASH",
    "DESTINATION_MISSING",
    "DESTINATION_SIZE",
    "DESTINATION_SHA256",
    "SEVERAL_MAPPINGS_OF_A_FILE",
    "DESTINATION_OF_SEVERAL_FILES",
    "STILL_AT_PRIOR_DESTINATION",
]


def _posix(c: str) -> Column:
    return F.rtrim(F.replace(F.col(c), F.lit("\\"), F.lit("/")), F.lit("/"))


def _short(x: Column) -> Column:
    """A checksum in half its length, which is most of a row: pairs of lower-case hex digits as bytes; other texts as they are."""
    text = x.cast("string")
    hexadecimal = text.rlike("^([0-9a-f]{2})+$")
    return F.when(hexadecimal, F.concat(F.lit(bytearray(b"\x01")), F.unhex(text))).otherwise(F.concat(F.lit(bytearray(b"\x00")), text.cast("binary")))


def successor_issues(mappings: DataFrame, prior: DataFrame, successors: DataFrame, inventory: DataFrame) -> DataFrame:
    """prior_move, prior_path and issues (names in the order of the rules; none: the file counts as moved on) of each mapping.

    mappings has the columns of REQUIRED. prior: (move, destination, path, size, sha), a row a file that a move of the prior ledger took.
    successors: (manifest, move, source, destination, status, verified_at, sha), a row a move of a later ledger. inventory: (path, size, sha)
    of the files there are. Keys of prior and successors are unique.
    """
    m = mappings.select(*REQUIRED).withColumns({c: _posix(c) for c in ("prior_destination", "prior_path", "successor_source", "successor_destination")})
    p = prior.select(F.col("move").alias("prior_move"), _posix("path").alias("prior_path"), _posix("destination").alias("p_destination"), F.col("size").alias("p_size"), _short(F.col("sha")).alias("p_sha"), F.lit(True).alias("p_file"))
    moves = prior.groupBy(F.col("move").alias("prior_move")).agg(F.max(_posix("destination")).alias("m_destination"), F.lit(True).alias("p_row"))
    manifests = successors.select(F.col("manifest").alias("successor_manifest")).distinct().withColumn("s_manifest", F.lit(True))
    s = successors.select(F.col("manifest").alias("successor_manifest"), F.col("move").alias("successor_move"), _posix("source").alias("s_source"), _posix("destination").alias("s_destination"), "status", "verified_at", _short(F.col("sha")).alias("s_sha"), F.lit(True).alias("s_row"))
    there = inventory.select(F.col("path").alias("successor_destination"), F.col("size").alias("d_size"), _short(F.col("sha")).alias("d_sha"), F.lit(True).alias("d_file"))
    left = inventory.select(F.col("path").alias("own"), F.lit(True).alias("still"))
    dup = m.groupBy("prior_destination", "prior_path").agg(F.count(F.lit(1)).alias("n_prior"))
    shared = m.groupBy("successor_destination").agg(F.count(F.lit(1)).alias("n_successor"))
    c = F.col
    no = lambda x: c(x).isNull()
    differ = lambda a, b: ~c(a).eqNullSafe(c(b))
    escapes = lambda x: F.coalesce(c(x).rlike(r"^(/|[A-Za-z]:)|(^|/)\.\.(/|$)"), F.lit(False))
    lacking = reduce(lambda a, b: a | b, (no(x) | (c(x).cast("string") == "") for x in REQUIRED))

    def judged(df: DataFrame, rules: dict[str, Column], *spent: str) -> DataFrame:
        """df with what the rules say, as bits, and without the columns that are not needed any more: rows get shorter before they travel on."""
        bits = reduce(lambda a, b: a.bitwiseOR(b), (F.when(x, 1 << RULES.index(k)).otherwise(0) for k, x in rules.items()), c("bits"))
        return df.withColumn("bits", bits).drop(*spent)

    j = m.withColumns({"own": F.concat_ws("/", "prior_destination", "prior_path"), "bits": F.lit(0)})
    j = judged(j, {
        "FIELD_MISSING": lacking,
        "PATH_ESCAPE": escapes("prior_path") | escapes("successor_source") | escapes("successor_destination"),
        "SUCCESSOR_SOURCE": differ("successor_source", "own"),
    }, "own").withColumn("sha", _short(c("sha")))
    j = judged(j.join(s, ["successor_manifest", "successor_move"], "left"), {
        "SUCCESSOR_NOT_VERIFIED": ~no("s_row") & (F.coalesce(c("status") != "MOVED", F.lit(True)) | no("verified_at")),
        "SUCCESSOR_ROW_SOURCE": ~no("s_row") & differ("s_source", "successor_source"),
        "SUCCESSOR_ROW_DESTINATION": ~no("s_row") & differ("s_destination", "successor_destination"),
        "SUCCESSOR_PRE_HASH": ~no("s_row") & differ("s_sha", "sha"),
    }, "status", "verified_at", "s_source", "s_destination", "s_sha", "successor_source", "successor_move")
    j = judged(j.join(there, "successor_destination", "left").join(shared, "successor_destination", "left"), {
        "DESTINATION_MISSING": no("d_file"),
        "DESTINATION_SIZE": ~no("d_file") & differ("d_size", "size"),
        "DESTINATION_SHA256": ~no("d_file") & differ("d_sha", "sha"),
        "DESTINATION_OF_SEVERAL_FILES": c("n_successor") > 1,
    }, "d_file", "d_size", "d_sha", "n_successor", "successor_destination")
    j = judged(j.join(p, ["prior_move", "prior_path"], "left"), {
        "PRIOR_HASH_MISSING": ~no("p_file") & (no("p_size") | no("p_sha")),
        "PRIOR_SIZE": ~no("p_size") & differ("p_size", "size"),
        "PRIOR_SHA256": ~no("p_sha") & differ("p_sha", "sha"),
    }, "p_size", "p_sha", "size", "sha", "p_destination")
    j = judged(j.join(manifests, "successor_manifest", "left"), {
        "SUCCESSOR_MANIFEST_UNKNOWN": no("s_manifest"),
        "SUCCESSOR_MOVE_UNKNOWN": ~no("s_manifest") & no("s_row"),
    }, "s_manifest", "s_row", "successor_manifest")
    j = judged(j.join(moves, "prior_move", "left"), {
        "PRIOR_MOVE_UNKNOWN": no("p_row"),
        "PRIOR_DESTINATION": ~no("p_row") & differ("m_destination", "prior_destination"),
        "PRIOR_FILE_UNKNOWN": ~no("p_row") & no("p_file"),
    }, "p_row", "m_destination", "p_file")
    j = judged(j.join(dup, ["prior_destination", "prior_path"], "left"), {"SEVERAL_MAPPINGS_OF_A_FILE": c("n_prior") > 1}, "n_prior")
    j = j.withColumn("own", F.concat_ws("/", "prior_destination", "prior_path")).drop("prior_destination")
    j = judged(j.join(left, "own", "left"), {"STILL_AT_PRIOR_DESTINATION": ~no("still")}, "still", "own")
    said = F.array_compact(F.array(*(F.when(c("bits").bitwiseAND(1 << i) != 0, k) for i, k in enumerate(RULES))))
    return j.select("prior_move", "prior_path", said.alias("issues"))


def ledger_issues(prior: tuple[str, str], bound: tuple[str, str], successors: list[tuple[str, str | None, str]]) -> list[str]:
    """Faults of a chain's head: prior is the (path, sha) of the ledger, bound what the chain says of it, successors (path, said sha, sha)."""
    out = []
    if not bound[1]:
        out.append("PRIOR_MANIFEST_UNBOUND")
    elif bound[1] != prior[1]:
        out.append("PRIOR_MANIFEST_SHA256")
    if bound[0] and bound[0].replace("\\", "/") != prior[0].replace("\\", "/"):
        out.append("PRIOR_MANIFEST_PATH")
    if not successors:
        out.append("NO_SUCCESSOR_MANIFEST")
    for path, said, sha in successors:
        if path == prior[0]:
            out.append("LEDGER_CYCLE")
        elif said and said != sha:
            out.append("SUCCESSOR_MANIFEST_SHA256")
    return out
