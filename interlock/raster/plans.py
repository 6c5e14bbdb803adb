"""Image kernels applied to DataFrames of images; failures become rows with a reason."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from interlock.raster import features, kernels, outlines


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(photo_id, height, width, n_channels, data): decoded images of a folder; undecodable ones have -1 for sizes and no data.

    Files of no bytes have no row: Spark's file sources pass over them.
    """
    i = spark.read.format("image").option("dropInvalid", False).load(path)
    return i.select(F.element_at(F.split("image.origin", "/"), -1).alias("photo_id"), "image.height", "image.width", F.col("image.nChannels").alias("n_channels"), "image.data")


def orientations(spark: SparkSession, path: str) -> DataFrame:
    """(photo_id, orientation): the orientation tag of each file, null without one."""
    f = spark.read.format("binaryFile").load(path)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"photo_id": [x.rsplit("/", 1)[-1] for x in p["path"]], "orientation": pd.array([kernels.exif_orientation(bytes(c)) for c in p["content"]], "Int32")})

    return f.select("path", "content").mapInPandas(run, "photo_id string, orientation int")


def upright(images: DataFrame, tags: DataFrame) -> DataFrame:
    """Images turned as their tags (photo_id, orientation) say; images without a tag or without data stay as they are."""
    both = images.join(tags, "photo_id", "left")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for i, (h, w, n, data, tag) in enumerate(zip(p["height"], p["width"], p["n_channels"], p["data"], p["orientation"])):
                if h > 0 and w > 0 and not pd.isna(tag) and int(tag) in range(2, 9):
                    turned = features.upright(np.frombuffer(data, np.uint8).reshape(h, w, n), int(tag))
                    p.iat[i, p.columns.get_loc("height")], p.iat[i, p.columns.get_loc("width")] = turned.shape[:2]
                    p.iat[i, p.columns.get_loc("data")] = turned.tobytes()
            yield p.drop(columns="orientation")

    return both.select("photo_id", "height", "width", "n_channels", "data", "orientation").mapInPandas(run, "photo_id string, height int, width int, n_channels int, data binary")


def _channels(row) -> np.ndarray | None:
    """An image row in colour (blue, green, red and perhaps alpha), None for a gray one."""
    a = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, -1)
    return a if a.shape[2] >= 3 else None


def pages(images: DataFrame) -> DataFrame:
    """(photo_id, corners): the four corners of the page or board in each photo, null where there is none."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            found = [features.page_corners(pixels(r)) if r.height > 0 and r.width > 0 else None for r in p.itertuples(index=False)]
            yield pd.DataFrame({"photo_id": p["photo_id"], "corners": [None if c is None else np.asarray(c, float).tolist() for c in found]})

    return images.mapInPandas(run, "photo_id string, corners array<array<double>>")


def key_codes(images: DataFrame, most: int = 500) -> DataFrame:
    """(photo_id, point_no, code): 256-bit codes of each image's key points as four numbers; images that can't be read have none."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = [(r.photo_id, i, c.astype(np.int64).tolist()) for r in p.itertuples(index=False) if r.height > 0 and r.width > 0 for i, c in enumerate(features.descriptors(pixels(r), most))]
            yield pd.DataFrame(out, columns=["photo_id", "point_no", "code"])

    return images.mapInPandas(run, "photo_id string, point_no int, code array<long>")


def code_scores(pairs: DataFrame, codes: DataFrame, below: int = 50) -> DataFrame:
    """(a, b, n_matched, score) of pairs of photos (a, b) by their key points' codes; 0 where none match."""
    lists = codes.groupBy("photo_id").agg(F.sort_array(F.collect_list(F.struct("point_no", "code"))).alias("c"))  # at most ``most`` codes a photo
    side = lambda n: lists.select(F.col("photo_id").alias(n), F.transform("c", lambda s: s["code"]).alias(f"c{n}"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grid = lambda v: np.zeros((0, 4), np.uint64) if v is None else np.array([list(c) for c in v], np.int64).astype(np.uint64)
        for p in parts:
            out = []
            for a, b, one, two in p.itertuples(index=False):
                x, y = grid(one), grid(two)
                found = features.matched(x, y, below)
                apart = sum(m[2] for m in found) / max(1, len(found))
                out.append((a, b, len(found), 0.6 * (1 - apart / 256) + 0.4 * min(len(found) / max(len(x), len(y), 1), 1.0) if found else 0.0))
            yield pd.DataFrame(out, columns=["a", "b", "n_matched", "score"])

    kinds = dict(pairs.dtypes)
    rows = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").select("a", "b", "ca", "cb")
    return rows.mapInPandas(run, f"a {kinds['a']}, b {kinds['b']}, n_matched int, score double")


def pixels(row) -> np.ndarray:
    """An image row as a 2-D array of gray."""
    if row.height <= 0 or row.width <= 0:
        raise ValueError("undecodable image")
    a = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, -1)
    return a[..., 0] if a.shape[2] == 1 else kernels.gray(a[..., :3])


_CANDIDATE = "photo_id string, piece_no int, origin array<int>, height int, width int, mask binary, pixel_count long, is_complete boolean, reason string"


def pieces_of(images: DataFrame, method: str | None = None, min_area: int = 100, light_is_piece: bool | None = None) -> DataFrame:
    """One row a piece found in each photo, or one with a reason where there is none.

    ``method`` None tries all and keeps the best; 'graded' takes the first that is good enough, 'color' goes by colour, 'alpha' by transparency
    (touching pieces eroded apart); ``light_is_piece`` takes pixels over 127 as they are.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for row in p.itertuples(index=False):
                try:
                    img = pixels(row)
                    mask = kernels.threshold(img, 127) if light_is_piece else _segmented(row, img, method)
                    found = kernels.islands(kernels.without_stragglers(mask), min_area, ignore_border=False)
                    for k, (crop, origin, area, touches) in enumerate(found):
                        out.append((row.photo_id, k, list(origin), *crop.shape, crop.tobytes(), area, not touches, kernels.reject_reason(crop)))
                    if not found:
                        out.append((row.photo_id, 0, None, 0, 0, None, 0, False, "no piece"))
                except Exception as e:  # one bad photo must not end the job
                    out.append((row.photo_id, 0, None, 0, 0, None, 0, False, str(e)[:200]))
            yield pd.DataFrame(out, columns=["photo_id", "piece_no", "origin", "height", "width", "mask", "pixel_count", "is_complete", "reason"])

    return images.mapInPandas(run, _CANDIDATE)


def _segmented(row, img: np.ndarray, method: str | None) -> np.ndarray:
    if method is None:
        return kernels.segment_best(img)
    color = _channels(row)
    if method == "graded":
        return features.segment_graded(img, None if color is None else color[..., :3])[0]
    if method == "color":
        return features.segment_by_color(np.dstack([img] * 3) if color is None else color[..., :3])
    if method == "alpha":
        return kernels.most_parts(features.alpha_mask(img if color is None else color))
    return kernels.segment(img, method)


_SIDE = "photo_id string, piece_no int, side_index int, vertices array<array<int>>, piece_center array<int>, incenter array<int>, is_edge boolean, reason string"


def sides_of(candidates: DataFrame, by_diagonals: bool = False) -> DataFrame:
    """Four side rows of each piece, or one with a reason where it can't be vectorised; corners by area or ``by_diagonals``."""
    pick = features.corner_diagonals if by_diagonals else None

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for row in p.itertuples(index=False):
                if row.reason is not None:
                    continue
                try:
                    for s in outlines.vectorised(np.frombuffer(row.mask, np.uint8).reshape(row.height, row.width), pick=pick):
                        out.append((row.photo_id, row.piece_no, s["side_index"], s["vertices"], s["piece_center"], s["incenter"], s["is_edge"], None))
                except Exception as e:
                    out.append((row.photo_id, row.piece_no, None, None, None, None, None, str(e)[:200]))
            d = pd.DataFrame(out, columns=["photo_id", "piece_no", "side_index", "vertices", "piece_center", "incenter", "is_edge", "reason"])
            yield d.astype({"side_index": "Int32", "is_edge": "boolean"})

    return candidates.mapInPandas(run, _SIDE)


def hashes(candidates: DataFrame) -> DataFrame:
    """(photo_id, piece_no, code): 64-bit perceptual hash of each piece's mask."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            p = p[p["reason"].isna()]
            yield pd.DataFrame({"photo_id": p["photo_id"], "piece_no": p["piece_no"], "code": [kernels.perceptual_hash(np.frombuffer(m, np.uint8).reshape(h, w) * 255) for m, h, w in zip(p["mask"], p["height"], p["width"])]})

    return candidates.mapInPandas(run, "photo_id string, piece_no int, code long")
