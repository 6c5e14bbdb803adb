"""Reading and writing the pipeline's files: side records, photo lists, connectivity, boards, drawings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from interlock.operators.match import thousandths

SIDE = (
    "piece_id long, side_index int, vertices array<array<int>>, piece_center array<int>, is_edge boolean, incenter array<int>, original_photo_name string, photo_space_origin array<int>, "
    "photo_space_centroid array<double>, photo_space_incenter array<double>, photo_width int, photo_height int, is_complete boolean, scale_factor double, bmp_width int, bmp_height int"
)
COLOR = "center_color array<double>, overall_histogram struct<h:array<double>,s:array<double>,v:array<double>>"


def read_sides(spark: SparkSession, folder: str) -> DataFrame:
    """Side records of a folder of JSON files, one object a file, with the defaults for what a file lacks.

    Files that can't be read drop out; ids missing in a record come from its file's name.
    """
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    raw = spark.read.schema(SIDE).option("multiLine", True).json(f"{folder}/side_*.json")
    rows = raw.withColumn("file", name)
    part = lambda k: F.regexp_extract("file", r"side_(\d+)_(\d)\.json$", k)
    return rows.select(
        F.coalesce("piece_id", F.try_to_number(part(1), F.lit("99999999999999")).cast("long")).alias("piece_id"), F.coalesce("side_index", part(2).try_cast("int")).alias("side_index"), "vertices", "piece_center", F.coalesce("is_edge", F.lit(False)).alias("is_edge"), "incenter",
        F.coalesce("original_photo_name", F.lit("")).alias("original_photo_name"), "photo_space_origin", "photo_space_centroid", "photo_space_incenter",
        F.coalesce("photo_width", F.lit(500)).alias("photo_width"), F.coalesce("photo_height", F.lit(500)).alias("photo_height"), F.coalesce("is_complete", F.lit(True)).alias("is_complete"), F.coalesce("scale_factor", F.lit(1.0)).alias("scale_factor"),
    ).where(F.col("piece_id").isNotNull() & F.col("side_index").isNotNull())


def whole_pieces(sides: DataFrame) -> DataFrame:
    """One row a piece with all four sides of two or more vertices, its sides in order."""
    g = sides.where(F.size("vertices") >= 2).groupBy("piece_id").agg(F.sort_array(F.collect_set(F.struct("side_index", "vertices", "piece_center", "is_edge"))).alias("sides"))
    return g.where(F.size("sides") == 4)


def read_photo_list(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, position) of a batch file's photos."""
    b = spark.read.schema("photos array<struct<file_name:string,position:array<double>>>").option("multiLine", True).json(path)
    return b.select(F.explode("photos").alias("p")).select("p.file_name", "p.position")


def read_connectivity(spark: SparkSession, path: str) -> DataFrame:
    """(piece_id, side, other_piece, other_side, err) of a connectivity file, errors back in units."""
    text = spark.read.option("wholetext", True).text(path)
    m = text.select(F.explode(F.from_json("value", "map<string,array<array<array<long>>>>")).alias("piece", "sides"))
    s = m.select(F.col("piece").cast("long").alias("piece_id"), F.posexplode("sides").alias("side", "fits"))
    return s.select("piece_id", "side", F.explode("fits").alias("f")).select("piece_id", "side", F.col("f")[0].alias("other_piece"), F.col("f")[1].cast("int").alias("other_side"), (F.col("f")[2] / 1000).alias("err"))


def read_colors(spark: SparkSession, folder: str) -> DataFrame:
    """(piece_id, center_color, overall_histogram) of colour feature files."""
    c = spark.read.schema(COLOR).option("multiLine", True).json(f"{folder}/color_features_*.json")
    return c.select(F.regexp_extract("_metadata.file_path", r"color_features_(\d+)\.json$", 1).cast("long").alias("piece_id"), "center_color", "overall_histogram")


def write_colors(colors: DataFrame, folder: str) -> None:
    """Colour features (piece_id, center_color, overall_histogram) as JSON, one object a line, partitioned by piece."""
    colors.write.mode("overwrite").partitionBy("piece_id").json(folder)


def write_sides(sides: DataFrame, folder: str, only_edges: bool = False) -> None:
    """Side records as JSON lines, partitioned by nothing; ``only_edges`` keeps pieces with a flat side."""
    if only_edges:
        sides = sides.join(sides.where("is_edge").select("piece_id").distinct(), "piece_id", "left_semi")
    sides.write.mode("overwrite").json(folder)


def connectivity_lines(fits: DataFrame) -> DataFrame:
    """(value): one JSON object a piece, ``{"<piece>": [[[other, side, thousandths] ...] x 4]}``."""
    one = [F.sort_array(F.collect_list(F.when(F.col("side") == k, F.struct(thousandths(F.col("err")).cast("long").alias("e"), F.col("other_piece").alias("p"), F.col("other_side").cast("long").alias("s"))))) for k in range(4)]
    g = fits.groupBy("piece_id").agg(*[c.alias(f"s{k}") for k, c in enumerate(one)])
    lists = F.array(*[F.transform(f"s{k}", lambda f: F.array(f["p"], f["s"], f["e"])) for k in range(4)])
    return g.select(F.to_json(F.create_map(F.col("piece_id").cast("string"), lists)).alias("value"))


def piece_svg(pieces: DataFrame) -> DataFrame:
    """(piece_id, svg): a drawing of each piece from its sides in order."""
    line = lambda s: F.array_join(F.transform(s["vertices"], lambda v: F.concat_ws(",", v[0], v[1])), " ")
    color = F.array(*[F.lit(c) for c in ("#d33", "#393", "#33d", "#a80")])
    parts = F.transform("sides", lambda s: F.concat(F.lit('<polyline fill="none" stroke="'), F.element_at(color, s["side_index"] + 1), F.lit('" points="'), line(s), F.lit('"/>')))
    return pieces.select("piece_id", F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg">'), F.array_join(parts, ""), F.lit("</svg>")).alias("svg"))


def catalog_html(cards: DataFrame) -> DataFrame:
    """(class, html): pieces by corner, edge and inner, a card each; ``cards`` has piece_id, class, photo."""
    card = F.format_string('<div class="card"><h3>#%s</h3><p>%s</p></div>', F.col("piece_id").cast("string"), F.coalesce("photo", F.lit("")))
    g = cards.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("piece_id", card.alias("h")))).alias("c"))
    return g.select("class", F.concat(F.lit("<section><h2>"), F.col("class"), F.lit("</h2>"), F.array_join(F.transform("c", lambda s: s["h"]), ""), F.lit("</section>")).alias("html"))


def board_svg(places: DataFrame, sides: DataFrame) -> DataFrame:
    """(board_id, svg): every board as one drawing, each piece's sides turned and moved to its place.

    ``places`` is what ``layout`` gives (board_id, piece_id, dest_x, dest_y, turn), ``sides`` has vertices and incenter.  A
    piece without sides is not drawn.  A board's drawing is one text of the size of the board.
    """
    color = F.array(*[F.lit(c) for c in ("#c00", "#990", "#0a9", "#33b")])
    s = sides.select("piece_id", "side_index", "vertices", "incenter").where((F.size("vertices") >= 2) & (F.size("incenter") >= 2))
    j = places.join(s, "piece_id")
    dx, dy = (lambda v: v[0] - F.col("incenter")[0]), (lambda v: v[1] - F.col("incenter")[1])
    x = lambda v: F.round(F.col("dest_x") + dx(v) * F.cos("turn") - dy(v) * F.sin("turn"), 1)
    y = lambda v: F.round(F.col("dest_y") + dx(v) * F.sin("turn") + dy(v) * F.cos("turn"), 1)
    points = F.array_join(F.transform("vertices", lambda v: F.concat_ws(",", x(v), y(v))), " ")
    line = F.concat(F.lit('<polyline fill="none" stroke="'), F.element_at(color, F.col("side_index") + 1), F.lit('" points="'), points, F.lit('"/>'))
    g = j.select("board_id", "piece_id", "side_index", line.alias("l")).groupBy("board_id").agg(F.sort_array(F.collect_list(F.struct("piece_id", "side_index", "l"))).alias("c"))
    return g.select("board_id", F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg">'), F.array_join(F.transform("c", lambda v: v["l"]), ""), F.lit("</svg>")).alias("svg"))


def guide_html(steps: DataFrame) -> DataFrame:
    """(board_id, html): the steps of ``assembly_order`` row by row as a page, with a heading where the kind of piece changes."""
    order = Window.partitionBy("board_id").orderBy("y", "x")
    head = F.when(F.lag("class").over(order).eqNullSafe(F.col("class")), F.lit("")).otherwise(F.concat(F.lit("<h2>"), F.col("class"), F.lit("</h2>")))
    beside = F.concat_ws(", ", *[F.when(F.col(f"{n}_id").isNotNull(), F.concat(F.lit(f"{n} #"), F.col(f"{n}_id").cast("string"))) for n in ("left", "right", "top", "bottom")])
    item = F.concat(head, F.format_string("<p>#%s at (%s, %s), %s; %s</p>", F.col("piece_id").cast("string"), F.col("x").cast("string"), F.col("y").cast("string"), F.col("turn"), beside))
    g = steps.withColumn("item", item).groupBy("board_id").agg(F.sort_array(F.collect_list(F.struct("y", "x", "item"))).alias("c"))
    return g.select("board_id", F.concat(F.lit("<html><body>"), F.array_join(F.transform("c", lambda v: v["item"]), ""), F.lit("</body></html>")).alias("html"))


def groups_html(groups: DataFrame, decisions: DataFrame) -> DataFrame:
    """(group_id, html): duplicate groups (id, group_id) as sections with their pairs' decisions (a, b, stage, total_rmse, ncc, confirms)."""
    inside = decisions.join(groups.select(F.col("id").alias("a"), "group_id"), "a").join(groups.select(F.col("id").alias("b"), F.col("group_id").alias("g2")), "b").where("group_id = g2")
    row = F.format_string("<li>%s - %s: stage %s, rmse %s, ncc %s, %s</li>", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("a", "b", "stage", "total_rmse", "ncc")], F.when(F.col("confirms"), "same").otherwise("open"))
    pairs = inside.groupBy("group_id").agg(F.sort_array(F.collect_list(F.struct("a", "b", row.alias("r")))).alias("p"))
    members = groups.groupBy("group_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda v: v.cast("string")), ", ").alias("m"))
    text = F.coalesce(F.array_join(F.transform("p", lambda v: v["r"]), ""), F.lit(""))
    return members.join(pairs, "group_id", "left").select("group_id", F.concat(F.lit("<section><h2>"), F.col("group_id").cast("string"), F.lit("</h2><p>"), F.col("m"), F.lit("</p><ul>"), text, F.lit("</ul></section>")).alias("html"))
