"""Control-flow graphs of many functions at once: instructions (fn, address, mnemonic, op_str) -> blocks, edges, statistics.

Windows are within a function. An instruction is classed once; leaders, blocks and edges are projections and joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boardlens.functions import text as X
from boardlens.functions import vocabulary as V
from boardlens.operators import ordered
from boardlens.operators.images import is_epilogue
from boardlens.sources.stages import written

#: Rounds of a closure after which the tables of its rounds become one.
KEEP = 16


def kind_of(mnemonic: Column, op: Column, arch: str) -> Column:
    """return, call, branch, conditional or plain: the first that holds, in this order."""
    m, o = F.lower(F.trim(mnemonic)), F.lower(F.trim(op))
    arm, x86 = arch in ("arm", "thumb"), arch in ("x86", "x86_64")
    back = m == "ret"
    if arm:
        back |= (m == "bx") & o.contains("lr") | m.isin("pop", "ldr") & o.contains("pc") | (m == "mov") & o.contains("pc") & o.contains("lr")
    if arch == "riscv":
        back |= (m == "jr") & o.contains("ra")
    if x86:
        back |= m.startswith("ret") | m.isin("iretd", "iretw", "iretf")
    branch = m.isin(*V.BRANCHES.get(arch, ()))
    if arm or arch == "arm64":
        branch |= m.startswith("b.")
    if x86:
        branch |= m.startswith("j")
    maybe = {
        "arm": m.isin(*V.ARM_CONDITIONAL) | m.startswith("b.") | m.startswith("cb"),
        "arm64": m.rlike(r"^(?:b\.|cbn|tbn|cbz)"),
        "riscv": m.startswith("b") & (m != "bal"),
        "x86": m.startswith("j") & (m != "jmp") | m.startswith("loop"),
    }.get({"thumb": "arm", "x86_64": "x86"}.get(arch, arch), F.lit(False))
    return F.when(back, "return").when(m.isin(*V.CALLS.get(arch, ())), "call").when(maybe, "conditional").when(branch, "branch").otherwise("plain")


def indirect(mnemonic: Column, op: Column, arch: str) -> Column:
    m, o = F.lower(F.trim(mnemonic)), F.trim(op)
    by_name = {"arm": ("bx", "blr", "br"), "thumb": ("bx", "blr", "br"), "arm64": ("br", "blr", "ret"), "riscv": ("jr",)}.get(arch, ())
    out = o == ""
    if by_name:
        out |= m.isin(*by_name)
    if arch in ("x86", "x86_64"):
        out |= m.isin("jmp", "call") & ~o.startswith("0x")
    return out


def target(op: Column) -> Column:
    """The address of an operand that begins with 0x, else null."""
    return X.hex_to_decimal(F.nullif(F.regexp_extract(F.trim(op), "^0[xX]([0-9a-fA-F]+)$", 1), F.lit(""))).cast("long")


def classified(instructions: DataFrame, arch: str) -> DataFrame:
    return instructions.withColumns({"kind": kind_of(F.col("mnemonic"), F.col("op_str"), arch), "indirect": indirect(F.col("mnemonic"), F.col("op_str"), arch), "target": target(F.col("op_str"))})


def _marked(instructions: DataFrame, arch: str) -> DataFrame:
    """Classified instructions with `leads`: the entry, what follows a transfer, and targets of transfers inside the function.

    A transfer is also a row at its target's address, so one scan, one shuffle by function and one sort tell all three.
    """
    own = classified(instructions, arch)
    transfers = (F.col("kind") != "plain") & F.col("target").isNotNull()
    own = own.withColumn("marks", F.explode(F.when(transfers, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    own = own.withColumns({"address": F.when(F.col("marks"), F.col("target")).otherwise(F.col("address")), "kind": F.when(~F.col("marks"), F.col("kind")), "mark": F.when(F.col("marks"), F.col("target"))})
    w = W.partitionBy("fn").orderBy("address", F.desc("marks")).rowsBetween(W.unboundedPreceding, -1)
    every = own.withColumns({"before": F.last("kind", ignorenulls=True).over(w), "mark": F.last("mark", ignorenulls=True).over(w)}).where("not marks")
    return every.withColumn("leads", F.col("before").isNull() | (F.col("before") != "plain") | F.coalesce(F.col("mark") == F.col("address"), F.lit(False))).drop("mark", "marks", "before")


def leaders(instructions: DataFrame, arch: str) -> DataFrame:
    """(fn, address) of block starts."""
    return _marked(instructions, arch).where("leads").select("fn", "address")


def blocked(instructions: DataFrame, arch: str) -> DataFrame:
    """Classified instructions with their block's number within the function."""
    w = W.partitionBy("fn").orderBy("address").rowsBetween(W.unboundedPreceding, 0)
    return _marked(instructions, arch).withColumn("block", (F.sum(F.col("leads").cast("int")).over(w) - 1).cast("long")).drop("leads")


def _blocks(instructions: DataFrame, arch: str) -> DataFrame:
    """(fn, block, start_addr, end_addr, n, last instruction): grouped where the windows left the rows, without another shuffle."""
    last = F.max_by(F.struct("mnemonic", "op_str", "kind", "indirect", "target"), "address").alias("i")
    return blocked(instructions, arch).groupBy("fn", "block").agg(F.min("address").alias("start_addr"), F.max("address").alias("end_addr"), F.count("*").alias("n"), last)


def blocks(instructions: DataFrame, arch: str = "arm") -> DataFrame:
    return _blocks(instructions, arch).drop("i")


def _with_edges(instructions: DataFrame, arch: str) -> DataFrame:
    """A row for each block, with the array of its edges. A target inside the function begins a block, so it meets blocks, not instructions."""
    own = _blocks(instructions, arch)
    last = own.select("fn", "block", "start_addr", "end_addr", "n", "i.*").withColumn("next", F.lead("block").over(W.partitionBy("fn").orderBy("block")))
    last = last.join(own.select("fn", F.col("start_addr").alias("target"), F.col("block").alias("to")), ["fn", "target"], "left")
    at = F.concat(F.lit("0x"), F.lower(F.hex("target")))
    known, unknown = F.col("to").isNotNull(), F.lit(-1).cast("long")
    k, follows = F.col("kind"), F.col("next").isNotNull()

    def edge(where: Column, to: Column, kind: Column, comment: Column) -> Column:
        return F.when(where, F.struct(to.alias("to_block"), kind.alias("edge_type"), comment.alias("comment")))

    outside = F.when(F.col("indirect") | F.col("target").isNull(), F.concat(F.lit("indirect jump via "), F.concat_ws(" ", "mnemonic", "op_str"))).otherwise(F.concat(F.lit("jump target "), at, F.lit(" outside")))
    # One row for each block; its edges are made beside it.
    out = F.array(
        edge(k == "return", unknown, F.lit("return"), F.concat(F.lit("return via "), F.col("mnemonic"))),
        edge(k == "call", F.coalesce("to", unknown), F.lit("call"), F.when(known, F.concat(F.lit("call to "), at)).otherwise(F.concat(F.lit("call via "), F.col("mnemonic"), F.lit(" (target unknown)")))),
        edge((k == "call") & follows, F.col("next"), F.lit("fallthrough"), F.lit("return from call (fall-through)")),
        edge(k == "branch", F.coalesce("to", unknown), F.when(known, "jump").otherwise("indirect_jump"), F.when(known, F.concat(F.lit("jump to "), at)).otherwise(outside)),
        edge((k == "conditional") & follows, F.col("next"), F.lit("conditional_false"), F.lit("branch not taken (fall-through)")),
        edge((k == "conditional") & (known | F.col("indirect")), F.coalesce("to", unknown), F.when(known, "conditional_true").otherwise("indirect_jump"), F.when(known, F.concat(F.lit("branch taken to "), at)).otherwise(F.concat(F.lit("indirect branch via "), F.col("mnemonic")))),
        edge((k == "plain") & follows, F.col("next"), F.lit("fallthrough"), F.lit("")),
    )
    return last.select("fn", "block", "start_addr", "end_addr", "n", F.filter(out, lambda e: e.isNotNull()).alias("edges"))


def edges(instructions: DataFrame, arch: str = "arm") -> DataFrame:
    """(fn, from_block, to_block, edge_type, comment); to_block -1 is unknown."""
    return _with_edges(instructions, arch).select("fn", F.col("block").alias("from_block"), F.inline("edges"))


def predecessors(edge_rows: DataFrame) -> DataFrame:
    """(fn, block, preds): distinct predecessors, in the order of blocks."""
    return edge_rows.where("to_block >= 0").groupBy("fn", F.col("to_block").alias("block")).agg(F.array_sort(F.collect_set("from_block")).alias("preds"))


def statistics(instructions: DataFrame, arch: str = "arm") -> DataFrame:
    """(fn, entry_block, instructions, blocks, edges, edge_types as a map), from one row a block."""
    own = _with_edges(instructions, arch)

    def number(kind: str) -> Column:
        return F.sum(F.size(F.filter("edges", lambda e: e["edge_type"] == kind))).alias(kind)

    out = own.groupBy("fn").agg(F.min_by("block", "start_addr").alias("entry_block"), F.sum("n").alias("instructions"), F.count("*").alias("blocks"), F.sum(F.size("edges")).alias("edges"), *map(number, V.EDGE_TYPES))
    pairs = F.filter(F.array(*(F.struct(F.lit(t).alias("t"), F.col(t).alias("n")) for t in V.EDGE_TYPES)), lambda s: s["n"] > 0)
    return out.select("fn", "entry_block", "instructions", "blocks", "edges", F.map_from_entries(pairs).alias("edge_types"))


def as_json(instructions: DataFrame, arch: str = "arm") -> DataFrame:
    """(fn, json) with hexadecimal addresses, blocks and edges in order."""

    def address(c: Column) -> Column:
        return F.concat(F.lit("0x"), F.lower(F.hex(c)))

    own = _with_edges(instructions, arch).select("fn", F.struct("block", address(F.col("start_addr")).alias("start"), address(F.col("end_addr")).alias("end")).alias("b"), F.transform("edges", lambda e: F.struct(F.col("block").alias("from_block"), e["to_block"].alias("to_block"), e["edge_type"].alias("edge_type"), e["comment"].alias("comment"))).alias("e"))
    out = own.groupBy("fn").agg(F.array_sort(F.collect_list("b")).alias("blocks"), F.array_sort(F.flatten(F.collect_list("e"))).alias("edges"))
    return out.select("fn", F.to_json(F.struct("blocks", "edges")).alias("json"))


def call_target(op: Column) -> Column:
    """The address that an operand begins with 0x or has behind its last #, else null."""
    whole = F.regexp_extract(F.trim(op), "^0[xX]([0-9a-fA-F]+)$", 1)
    behind = F.regexp_extract(F.trim(op), "#\\s*0x([0-9a-fA-F]+)$", 1)
    return X.hex_to_decimal(F.nullif(F.coalesce(F.nullif(whole, F.lit("")), behind), F.lit(""))).cast("long")


def call_closure(instructions: DataFrame, entries: DataFrame, arch: str = "arm", most: int = 200) -> DataFrame:
    """(address, depth, has_code) of functions reached from entries (address) by calls; depth counts calls from the nearest entry.

    A function is swept from its address over at most `most` instructions, up to the first epilogue; its direct bl, blx and bx targets are functions,
    without their Thumb bit. Targets without an instruction at their address count, and are not swept.

    An instruction belongs to all functions that start at most `most` places before it with no epilogue between. So calls and starts have a place and the
    number of epilogues before it, and meet by that number and by blocks of `most` places. Each round looks only at addresses that are new
    (semi-naive); their tables are written, so a round's plan doesn't grow with the rounds.
    """
    own = instructions.select(F.col("address").cast("long").alias("address"), F.lower(F.trim("mnemonic")).alias("m"), is_epilogue(F.col("mnemonic"), F.col("op_str"), arch).alias("stops"), call_target(F.col("op_str")).alias("to"))
    placed = ordered.sliced(ordered.numbered(own, ["address"]), 0)
    # Epilogues before an instruction: those in its slice, and those of the slices before, of which there is a row each.
    per = placed.groupBy("slice_").agg(F.count_if("stops").alias("n"))
    per = per.select("slice_", F.coalesce(F.sum("n").over(W.orderBy("slice_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("above"))
    inside = F.coalesce(F.sum(F.col("stops").cast("long")).over(W.partitionBy("slice_").orderBy("place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = written(placed.withColumn("inside", inside).join(per, "slice_").select("address", "place", (F.col("inside") + F.col("above")).alias("run"), F.when(F.col("m").isin(*V.FOLLOWED), F.col("to").bitwiseAND(-2)).alias("to")), "placed")
    block = F.floor(F.col("place") / most)
    calls = placed.where("to is not null").select("run", "to", F.col("place").alias("at"), F.explode(F.array(block, block - 1)).alias("block"))
    calls = written(calls.repartition("run", "block"), "calls")
    known = frontier = written(entries.select(F.col("address").cast("long").bitwiseAND(-2).alias("address"), F.lit(0).alias("depth")).distinct(), "reached")
    depth = 0
    while not frontier.isEmpty():
        depth += 1
        starts = placed.join(frontier.select("address"), "address", "left_semi").select("run", "place", block.alias("block"))
        met = starts.join(calls, ["run", "block"]).where((F.col("at") >= F.col("place")) & (F.col("at") < F.col("place") + most))
        frontier = written(met.select(F.col("to").alias("address")).distinct().join(known.select("address"), "address", "left_anti").withColumn("depth", F.lit(depth)), "reached")
        known = known.unionByName(frontier)
        if depth % KEEP == 0:
            known = written(known, "reached")
    return known.join(placed.select("address", F.lit(True).alias("has_code")).distinct(), "address", "left").withColumn("has_code", F.coalesce("has_code", F.lit(False)))
