"""Grids as tables of cells: blocks, transformations as maps of coordinates, layouts learnt and applied for all tasks at once.

A cell: task_id, split, pair_type, pair_index, grid_role, row, column, color, grid_height, grid_width.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPERATORS = ("background", "copy", "flip_horizontal", "flip_vertical", "rotate_180", "rotate_270", "rotate_90")
PAIR = ["task_id", "pair_type", "pair_index"]


def coordinates(spark: SparkSession, height: int, width: int, block: tuple[int, int] | None = None) -> DataFrame:
    """row and column of each cell of a grid, and with a block shape those of its block and within it."""
    if height < 1 or width < 1:
        raise ValueError("a shape must be positive")
    cells = spark.range(height * width).select(F.expr(f"CAST(id div {width} AS int)").alias("row"), (F.col("id") % width).cast("int").alias("column"))
    if block is None:
        return cells
    h, w = block
    if h < 1 or w < 1:
        raise ValueError("a block shape must be positive")
    if height % h or width % w:
        raise ValueError("the shape is not a multiple of the block shape")
    return cells.withColumns(block_coordinates(F.lit(h), F.lit(w)))


def block_coordinates(h: Column, w: Column) -> dict[str, Column]:
    r, c = F.col("row"), F.col("column")
    return {
        "block_row": F.floor(r / h).cast("int"), "block_column": F.floor(c / w).cast("int"),
        "within_block_row": (r % h).cast("int"), "within_block_column": (c % w).cast("int"),
    }


def transformed(cells: DataFrame, background: int = 0) -> DataFrame:
    """Each cell under every operator that keeps the grid's shape: operator, row, column, color where it goes to."""
    r, c, h, w, color = (F.col(x) for x in ("row", "column", "grid_height", "grid_width", "color"))
    square = h == w
    to = lambda name, row, column, value=color: F.struct(F.lit(name).alias("operator"), row.cast("int").alias("to_row"), column.cast("int").alias("to_column"), value.cast("int").alias("value"))
    always = F.array(
        to("copy", r, c), to("flip_horizontal", r, w - 1 - c), to("flip_vertical", h - 1 - r, c), to("rotate_180", h - 1 - r, w - 1 - c), to("background", r, c, F.lit(background)),
    )
    turned = F.array(to("rotate_90", w - 1 - c, r), to("rotate_270", c, h - 1 - r))
    made = cells.withColumn("_t", F.explode(F.when(square, F.concat(always, turned)).otherwise(always)))
    return made.select(*[x for x in cells.columns if x not in ("row", "column", "color")], F.col("_t.operator").alias("operator"), F.col("_t.to_row").alias("within_block_row"), F.col("_t.to_column").alias("within_block_column"), F.col("_t.value").alias("value"))


def pair_shapes(cells: DataFrame) -> DataFrame:
    """A row per training pair: input and output shapes, whether blocks tile the output, and how many each way."""
    pick = lambda role, x: F.max(F.when(F.col("grid_role") == role, F.col(x)))
    s = cells.where("pair_type = 'train'").groupBy(*PAIR).agg(*(pick(role, f"grid_{x}").alias(f"{role}_{x}") for role in ("input", "output") for x in ("height", "width")))
    fits = (F.col("output_height") % F.col("input_height") == 0) & (F.col("output_width") % F.col("input_width") == 0)
    return s.withColumns({"tiles": F.coalesce(fits, F.lit(False)), "block_rows": F.expr("CAST(output_height div input_height AS int)"), "block_columns": F.expr("CAST(output_width div input_width AS int)")})


def evidence(cells: DataFrame, background: int = 0) -> DataFrame:
    """Operators that explain a whole block of a training output: PAIR, block_row, block_column, operator, state (of the
    input cell at the block's place)."""
    train = cells.where("pair_type = 'train'")
    shapes = pair_shapes(cells).where("tiles")
    output = train.where("grid_role = 'output'").join(shapes.select(*PAIR, "input_height", "input_width"), PAIR).withColumns(block_coordinates(F.col("input_height"), F.col("input_width")))
    inputs = train.where("grid_role = 'input'")
    moved = transformed(inputs, background).select(*PAIR, "operator", "within_block_row", "within_block_column", "value")
    matched = output.select(*PAIR, "block_row", "block_column", "within_block_row", "within_block_column", "color").join(moved, [*PAIR, "within_block_row", "within_block_column"])
    whole = matched.groupBy(*PAIR, "block_row", "block_column", "operator").agg(F.bool_and(F.col("color") == F.col("value")).alias("ok")).where("ok").drop("ok")
    state = F.when(F.col("color") == background, "background").otherwise("foreground")
    states = inputs.select(*PAIR, F.col("row").alias("block_row"), F.col("column").alias("block_column"), state.alias("state"))
    return whole.join(states, [*PAIR, "block_row", "block_column"], "left")


def _status(*cases: tuple[Column, str]) -> Column:
    out = None
    for condition, name in cases:
        condition = F.coalesce(condition, F.lit(False))
        out = F.when(condition, name) if out is None else out.when(condition, name)
    return out.otherwise("ok")


def _task_facts(cells: DataFrame, found: DataFrame) -> DataFrame:
    shapes = pair_shapes(cells)
    blocks = found.select(*PAIR, "block_row", "block_column").distinct().groupBy("task_id").agg(F.count("*").alias("matched_blocks"))
    facts = shapes.groupBy("task_id").agg(
        F.count("*").alias("pairs"), F.bool_and("tiles").alias("all_tile"), F.count_distinct("block_rows", "block_columns").alias("layout_shapes"),
        F.sum(F.col("block_rows") * F.col("block_columns")).alias("all_blocks"), F.max(F.col("block_rows") * F.col("block_columns")).alias("layout_blocks"),
        F.bool_and((F.col("block_rows") == F.col("input_height")) & (F.col("block_columns") == F.col("input_width"))).alias("state_shape"),
    )
    return facts.join(blocks, "task_id", "left").fillna(0, ["matched_blocks"])


def fixed_layouts(cells: DataFrame, found: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """layout (task_id, block_row, block_column, operator) shared by a task's pairs, and status per task. found: the
    evidence, where it has been gathered already."""
    found = evidence(cells) if found is None else found
    facts = _task_facts(cells, found)
    votes = found.groupBy("task_id", "block_row", "block_column", "operator").agg(F.count("*").alias("votes"))
    shared = votes.join(facts.select("task_id", "pairs"), "task_id").where("votes = pairs")
    per_block = shared.groupBy("task_id", "block_row", "block_column").agg(F.count("*").alias("n"))
    counted = per_block.groupBy("task_id").agg(F.count("*").alias("resolved"), F.max("n").alias("most"))
    f = facts.join(counted, "task_id", "left").fillna(0, ["resolved", "most"])
    status = f.select("task_id", _status((~F.col("all_tile"), "not_tiling"), (F.col("matched_blocks") < F.col("all_blocks"), "no_operator"), (F.col("layout_shapes") > 1, "layout_shape_mismatch"), (F.col("resolved") < F.col("layout_blocks"), "none_shared"), (F.col("most") > 1, "ambiguous")).alias("status"))
    good = status.where("status = 'ok'").select("task_id")
    return shared.join(good, "task_id", "left_semi").select("task_id", "block_row", "block_column", "operator"), status


def state_operators(cells: DataFrame, background: int = 0, found: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The operator of background and of foreground cells (task_id, state, operator), and status per task."""
    found = evidence(cells, background) if found is None else found
    facts = _task_facts(cells, found)
    state = F.when(F.col("color") == background, "background").otherwise("foreground")
    seen = cells.where("pair_type = 'train' AND grid_role = 'input'").groupBy("task_id", state.alias("state")).agg(F.count("*").alias("observed"))
    votes = found.where("state IS NOT NULL").groupBy("task_id", "state", "operator").agg(F.count("*").alias("votes"))
    shared = votes.join(seen, ["task_id", "state"]).where("votes = observed")
    per_state = shared.groupBy("task_id", "state").agg(F.count("*").alias("n")).groupBy("task_id").agg(F.count("*").alias("resolved"), F.max("n").alias("most"))
    states = seen.groupBy("task_id").agg(F.count("*").alias("states"))
    f = facts.join(states, "task_id", "left").join(per_state, "task_id", "left").fillna(0, ["states", "resolved", "most"])
    status = f.select("task_id", _status((~F.col("all_tile"), "not_tiling"), (~F.col("state_shape"), "state_shape_mismatch"), (F.col("matched_blocks") < F.col("all_blocks"), "no_operator"), (F.col("states") < 2, "state_unobserved"), (F.col("resolved") < 2, "none_shared"), (F.col("most") > 1, "ambiguous")).alias("status"))
    good = status.where("status = 'ok'").select("task_id")
    return shared.join(good, "task_id", "left_semi").select("task_id", "state", "operator"), status


def state_layouts(tests: DataFrame, operators: DataFrame, background: int = 0) -> DataFrame:
    """The layout of each test grid from its own cells: task_id, pair_index, block_row, block_column, operator."""
    state = F.when(F.col("color") == background, "background").otherwise("foreground")
    return tests.select("task_id", "pair_index", F.col("row").alias("block_row"), F.col("column").alias("block_column"), state.alias("state")).join(operators, ["task_id", "state"]).drop("state")


def compose(tests: DataFrame, layout: DataFrame, background: int = 0) -> DataFrame:
    """Predicted cells of test grids (task_id, pair_index, row, column, color) and whether all blocks could be made."""
    on = [c for c in ("task_id", "pair_index") if c in layout.columns]
    blocks = layout.groupBy(*on).agg(F.count("*").alias("_blocks"))
    made = transformed(tests, background).join(layout, [*on, "operator"]).select("task_id", "pair_index", "grid_height", "grid_width", "value", (F.col("block_row") * F.col("grid_height") + F.col("within_block_row")).alias("row"), (F.col("block_column") * F.col("grid_width") + F.col("within_block_column")).alias("column"))
    w = Window.partitionBy("task_id", "pair_index")
    made = made.join(blocks, on).withColumn("complete", F.count("*").over(w) == F.col("_blocks") * F.col("grid_height") * F.col("grid_width"))
    return made.select("task_id", "pair_index", "row", "column", F.col("value").alias("color"), "complete")


def solve(cells: DataFrame, background: int = 0) -> tuple[DataFrame, DataFrame]:
    """Predictions (task_id, pair_index, row, column, color) and per task solver, fixed_status and state_status.

    The fixed layout goes first; the state layout where it fails; the test inputs where both do (solver: fallback)."""
    tests = cells.where("pair_type = 'test' AND grid_role = 'input'")
    found = evidence(cells, background).persist()  # both solvers read it, as they do each other's results below
    layout, fixed_status = (x.persist() for x in fixed_layouts(cells, found))
    operators, state_status = (x.persist() for x in state_operators(cells, background, found))
    fixed = compose(tests, layout, background).persist()
    state = compose(tests, state_layouts(tests, operators, background), background).persist()
    n_tests = tests.select("task_id", "pair_index").distinct().groupBy("task_id").agg(F.count("*").alias("tests"))

    def supported(made: DataFrame, status: DataFrame, name: str) -> DataFrame:
        whole = made.where("complete").select("task_id", "pair_index").distinct().groupBy("task_id").agg(F.count("*").alias("_whole"))
        both = n_tests.join(status, "task_id", "left").join(whole, "task_id", "left")
        bad = (F.col("status") == "ok") & (F.coalesce("_whole", F.lit(0)) < F.col("tests"))
        return both.select("task_id", F.when(bad, "unsupported_operator").otherwise(F.coalesce("status", F.lit("no_training_pairs"))).alias(name))

    tasks = supported(fixed, fixed_status, "fixed_status").join(supported(state, state_status, "state_status"), "task_id")
    tasks = tasks.withColumn("solver", F.when(F.col("fixed_status") == "ok", "fixed").when(F.col("state_status") == "ok", "state").otherwise("fallback")).persist()
    as_is = tests.select("task_id", "pair_index", "row", "column", "color")
    out = None
    for name, made in (("fixed", fixed.drop("complete")), ("state", state.drop("complete")), ("fallback", as_is)):
        mine = made.join(tasks.where(F.col("solver") == name).select("task_id"), "task_id", "left_semi").select("task_id", "pair_index", F.col("row").cast("int"), F.col("column").cast("int"), F.col("color").cast("int"))
        out = mine if out is None else out.unionByName(mine)
    return out, tasks


def evaluate(predictions: DataFrame, cells: DataFrame) -> DataFrame:
    """Per test grid with a known output: whether all its cells are predicted and no others."""
    truth = cells.where("pair_type = 'test' AND grid_role = 'output'").select("task_id", "pair_index", "row", "column", F.col("color").alias("true_color"))
    known = truth.select("task_id", "pair_index").distinct()
    both = truth.join(predictions.join(known, ["task_id", "pair_index"], "left_semi"), ["task_id", "pair_index", "row", "column"], "full")
    return both.groupBy("task_id", "pair_index").agg(F.bool_and(F.coalesce(F.col("color") == F.col("true_color"), F.lit(False))).alias("exact"))


def grids(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys and grid (array of rows) of cells."""
    rows = cells.groupBy(*keys, "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("column", "color"))), lambda x: x["color"]).alias("colors"))
    return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "colors"))), lambda x: x["colors"]).alias("grid"))


def submission(predictions: DataFrame) -> DataFrame:
    """task_id and attempts: for each test grid the same prediction twice."""
    g = grids(predictions, ["task_id", "pair_index"])
    one = F.struct(F.col("grid").alias("attempt_1"), F.col("grid").alias("attempt_2"))
    return g.groupBy("task_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pair_index", one.alias("a")))), lambda x: x["a"]).alias("attempts"))


def leave_out(cells: DataFrame, task_id: str, n_pairs: int) -> DataFrame:
    """The task's cells once for each proper subset of training pairs: the pairs left out are its tests. task_id gets
    the subset's name; a task has a handful of pairs."""
    mine = cells.where((F.col("task_id") == task_id) & (F.col("pair_type") == "train"))
    subsets = [s for k in range(1, n_pairs) for s in combinations(range(n_pairs), k)]
    named = F.explode(F.array(*(F.struct(F.lit(f"{task_id}:{'-'.join(map(str, s))}").alias("name"), F.array(*map(F.lit, s)).alias("kept")) for s in subsets)))
    all_of = mine.withColumn("_s", named)
    return all_of.withColumns({"task_id": F.col("_s.name"), "pair_type": F.when(F.array_contains("_s.kept", F.col("pair_index").cast("int")), "train").otherwise("test")}).drop("_s")


# ---- one object grid composed into an output ----


def partition_blocks(object_cells: DataFrame, output_cells: DataFrame, height: int, width: int, background: int) -> DataFrame:
    """Output cells (row, column, value) with their block and what the object and its mirror image have there."""
    placed = output_cells.withColumns(block_coordinates(F.lit(height), F.lit(width)))
    original = object_cells.select(F.col("row").alias("within_block_row"), F.col("column").alias("within_block_column"), F.col("value").alias("original_value"))
    mirrored = object_cells.select(F.col("row").alias("within_block_row"), (F.lit(width - 1) - F.col("column")).cast("int").alias("within_block_column"), F.col("value").alias("reflected_value"))
    on = ["within_block_row", "within_block_column"]
    both = placed.join(original, on).join(mirrored, on)
    v = F.col("value")
    return both.withColumns({"matches_original": v == F.col("original_value"), "matches_reflected": v == F.col("reflected_value"), "matches_background": v == background})


def compare_blocks(cells: DataFrame) -> DataFrame:
    """The instruction of each block: copy before reflect_horizontal before fill_background, else unknown."""
    b = cells.groupBy("block_row", "block_column").agg(*(F.bool_and(f"matches_{x}").alias(f"equals_{x}") for x in ("original", "reflected", "background")), F.count("*").alias("cell_count"))
    return b.withColumn("instruction", F.when(F.col("equals_original"), "copy").when(F.col("equals_reflected"), "reflect_horizontal").when(F.col("equals_background"), "fill_background").otherwise("unknown"))


def block_compose(blocks: DataFrame, object_cells: DataFrame, height: int, width: int, background: int) -> DataFrame:
    """Cells (row, column, value) of an output made from instructions; ValueError if one is unknown."""
    if blocks.where("instruction = 'unknown'").limit(1).count():
        raise ValueError("a block matches no known operator")
    o = object_cells
    kinds = F.array(
        F.struct(F.lit("copy").alias("instruction"), F.col("column").cast("int").alias("c"), F.col("value").cast("int").alias("v")),
        F.struct(F.lit("reflect_horizontal").alias("instruction"), (F.lit(width - 1) - F.col("column")).cast("int").alias("c"), F.col("value").cast("int").alias("v")),
        F.struct(F.lit("fill_background").alias("instruction"), F.col("column").cast("int").alias("c"), F.lit(background).cast("int").alias("v")),
    )
    made = o.withColumn("_k", F.explode(kinds)).select("row", "_k.*")
    both = blocks.select("block_row", "block_column", "instruction").join(made, "instruction")
    return both.select((F.col("block_row") * height + F.col("row")).cast("int").alias("row"), (F.col("block_column") * width + F.col("c")).cast("int").alias("column"), F.col("v").alias("value"))


def exact_match(a: DataFrame, b: DataFrame) -> bool:
    """Whether two cell tables (row, column, value) are equal."""
    both = a.join(b.withColumnRenamed("value", "_other"), ["row", "column"], "full")
    return both.where(~F.col("value").eqNullSafe(F.col("_other"))).limit(1).count() == 0


def kronecker(a: DataFrame, b: DataFrame, height: int, width: int) -> DataFrame:
    """The Kronecker product of two cell tables, b of the given shape. Both are small matrices."""
    x, y = (m.select(F.col("row").alias(f"{n}r"), F.col("column").alias(f"{n}c"), F.col("value").alias(f"{n}v")) for n, m in (("a", a), ("b", b)))
    both = x.withColumn("_", F.lit(0)).join(y.withColumn("_", F.lit(0)), "_")
    return both.select((F.col("ar") * height + F.col("br")).alias("row"), (F.col("ac") * width + F.col("bc")).alias("column"), (F.col("av") * F.col("bv")).alias("value"))


def cooccurrence(df: DataFrame, columns: list[str]) -> DataFrame:
    """first, second, both, either: rows in which two boolean columns hold together, or one of them does."""
    counts = [F.count_if(F.col(a) & F.col(b)).alias(f"and_{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns)]
    counts += [F.count_if(F.col(a) | F.col(b)).alias(f"or_{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns)]
    one = df.agg(*counts)
    entries = [F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(f"and_{i}_{j}").alias("both"), F.col(f"or_{i}_{j}").alias("either")) for i, a in enumerate(columns) for j, b in enumerate(columns)]
    return one.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
