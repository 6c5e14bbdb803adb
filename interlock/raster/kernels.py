"""Image kernels in numpy: one image in, numbers or images out.  Gray and mask images are 2-D, colour images BGR."""

from __future__ import annotations

import numpy as np

# -- light and colour


def gray(bgr: np.ndarray) -> np.ndarray:
    return np.rint(bgr.astype(float) @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def threshold(img: np.ndarray, level: float) -> np.ndarray:
    """1 where brighter than ``level``."""
    return (img > level).astype(np.uint8)


def gray_world(bgr: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """Channels scaled to a common mean (over the mask); a nearly black image stays as it is."""
    area = bgr[mask > 0] if mask is not None else bgr.reshape(-1, 3)
    if not len(area) or (means := area.mean(axis=0)).min() < 1e-6:
        return bgr
    out = np.clip(bgr.astype(float) * (means.mean() / means), 0, 255).astype(np.uint8)
    return out if mask is None else np.where(mask[..., None] > 0, out, bgr)


def equalised(img: np.ndarray) -> np.ndarray:
    counts = np.bincount(img.ravel(), minlength=256).cumsum()
    low = counts[counts > 0][0]
    return np.rint((counts - low) / max(1, counts[-1] - low) * 255).clip(0, 255).astype(np.uint8)[img]


def enhanced(img: np.ndarray) -> np.ndarray:
    """Equalised if flat, lightened if dark, darkened if bright."""
    out = equalised(img) if img.std() < 20 else img
    m = out.mean()
    return np.clip(out * (1.5 if m < 60 else 0.7 if m > 200 else 1.0), 0, 255).astype(np.uint8)


def otsu(img: np.ndarray) -> int:
    """The level that separates two classes best."""
    n = np.bincount(img.ravel(), minlength=256).astype(float)
    w = n.cumsum()
    s = (n * np.arange(256)).cumsum()
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (s[-1] * w / w[-1] - s) ** 2 / (w * (w[-1] - w))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def is_light_background(img: np.ndarray, band: float = 0.1) -> bool:
    h, w = img.shape
    a, b = max(1, int(h * band)), max(1, int(w * band))
    return float(np.median(np.concatenate([img[:a].ravel(), img[-a:].ravel(), img[:, :b].ravel(), img[:, -b:].ravel()]))) > 128


def histogram_hsv(bgr: np.ndarray, mask: np.ndarray | None = None) -> dict[str, list[float]]:
    """Counts of hue (36 bins), saturation and value (32 each) under a mask."""
    p = (bgr[mask > 0] if mask is not None else bgr.reshape(-1, 3)).astype(float) / 255
    v, low = (p.max(axis=1), p.min(axis=1)) if len(p) else (np.zeros(0), np.zeros(0))
    d = np.where(v > low, v - low, 1)
    b, g, r = p.T if len(p) else (v, v, v)
    h = np.select([v == low, v == r, v == g], [0 * v, (g - b) / d % 6, (b - r) / d + 2], (r - g) / d + 4) * 60
    s = np.where(v > 0, (v - low) / np.where(v > 0, v, 1), 0)
    count = lambda x, n, top: np.histogram(x, n, (0, top))[0].astype(float).tolist()
    return {"h": count(h, 36, 360), "s": count(s, 32, 1.0001), "v": count(v, 32, 1.0001)}


def color_band(bgr: np.ndarray, vertices: np.ndarray, width: int = 15, samples: int = 50) -> np.ndarray:
    """Mean colours of short horizontal strips along a side."""
    step = max(1, len(vertices) // samples)
    out = []
    for x, y in np.rint(vertices[::step]).astype(int):
        if 0 <= y < len(bgr) and (strip := bgr[y, max(0, x - width // 2) : max(0, x + width // 2 + 1)]).size:
            out.append(strip.reshape(-1, 3).mean(axis=0))
    return np.array(out).reshape(-1, 3)


# -- filters and morphology


def blur(img: np.ndarray, size: int) -> np.ndarray:
    """Gaussian of an odd width, edges repeated."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    k = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma**2))
    k /= k.sum()
    pad = np.pad(img.astype(float), size // 2, mode="edge")
    rows = np.apply_along_axis(np.convolve, 1, pad, k, "valid")
    return np.apply_along_axis(np.convolve, 0, rows, k, "valid")


def _shifted(mask: np.ndarray, size: int, fill: int, ellipse: bool) -> list[np.ndarray]:
    r = size // 2
    pad = np.pad(mask, r, constant_values=fill)
    offs = [(i, j) for i in range(size) for j in range(size) if not ellipse or ((i - r) ** 2 + (j - r) ** 2 <= (r + 0.3) ** 2)]
    return [pad[i : i + mask.shape[0], j : j + mask.shape[1]] for i, j in offs]


def dilated(mask: np.ndarray, size: int = 3, ellipse: bool = False) -> np.ndarray:
    return np.maximum.reduce(_shifted(mask, size, 0, ellipse))


def eroded(mask: np.ndarray, size: int = 3, ellipse: bool = False) -> np.ndarray:
    return np.minimum.reduce(_shifted(mask, size, 1, ellipse))


def opened(mask: np.ndarray, size: int = 3, ellipse: bool = False) -> np.ndarray:
    return dilated(eroded(mask, size, ellipse), size, ellipse)


def closed(mask: np.ndarray, size: int = 3, ellipse: bool = False) -> np.ndarray:
    return eroded(dilated(mask, size, ellipse), size, ellipse)


def segment_adaptive(img: np.ndarray, block: int = 51, smooth: int = 5, c: float = 10, morph: int = 5) -> np.ndarray:
    """Foreground against the local mean; darker than it on a light background, brighter on a dark one."""
    soft = blur(img, smooth)
    local = blur(soft, block)
    mask = (soft < local - c if is_light_background(img) else soft > local + c).astype(np.uint8)
    return opened(closed(mask, morph, True), morph, True)


def segment_otsu(img: np.ndarray, smooth: int = 5, morph: int = 5) -> np.ndarray:
    soft = np.rint(blur(img, smooth)).astype(np.uint8)
    level = otsu(soft)
    mask = (soft <= level if is_light_background(img) else soft > level).astype(np.uint8)
    return opened(closed(mask, morph, True), morph, True)


SEGMENTERS = {"adaptive": segment_adaptive, "otsu": segment_otsu}


def segment(img: np.ndarray, method: str = "adaptive") -> np.ndarray:
    if method not in SEGMENTERS:
        raise ValueError(f"unknown method {method!r}; known: {sorted(SEGMENTERS)}")
    return SEGMENTERS[method](img)


def segment_best(img: np.ndarray, min_pixels: int = 100) -> np.ndarray:
    """The result of the method with the best score; nothing if none finds enough."""
    best, score = np.zeros(img.shape, np.uint8), -1.0
    for f in SEGMENTERS.values():
        mask = f(img)
        if mask.sum() >= min_pixels and (s := segmentation_score(mask)) > score:
            best, score = mask, s
    return best


def segmentation_score(mask: np.ndarray) -> float:
    """0 to 1 from the share covered, the number of parts and how even their sizes are."""
    labels, n = components(mask)
    sizes = np.bincount(labels.ravel())[1:] if n else np.zeros(0)
    share = mask.mean()
    covered = 1.0 if 0.01 <= share <= 0.8 else 0.0
    parts = 1.0 if 1 <= n <= 200 else 0.0
    even = 1 / (1 + sizes.std() / sizes.mean()) if n else 0.0
    return 0.4 * covered + 0.3 * parts + 0.3 * even


# -- components


def components(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """Labels 1..n of 4-connected parts, numbered by their first pixel; 0 outside."""
    h, w = mask.shape
    flat = np.pad(mask > 0, ((0, 0), (1, 1))).astype(np.int8)
    edges = np.diff(flat, axis=1)
    ry, rx = np.nonzero(edges == 1)
    ends = np.nonzero(edges == -1)[1]
    up = list(range(len(ry)))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    starts = np.searchsorted(ry, np.arange(h + 1))
    for y in range(1, h):
        i, j = starts[y - 1], starts[y]
        while i < starts[y] and j < starts[y + 1]:
            if rx[i] < ends[j] and rx[j] < ends[i]:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
            if ends[i] < ends[j]:
                i += 1
            else:
                j += 1
    roots = np.array([find(i) for i in range(len(ry))], int)
    names, number = np.unique(roots, return_inverse=True)
    labels = np.zeros((h, w), np.int32)
    for y, a, b, n in zip(ry, rx, ends, number):
        labels[y, a:b] = n + 1
    return labels, len(names)


def largest_component(mask: np.ndarray) -> np.ndarray:
    labels, n = components(mask)
    return (labels == np.bincount(labels.ravel())[1:].argmax() + 1).astype(np.uint8) if n else mask * 0


def without_small(mask: np.ndarray, min_pixels: int = 100, value: int = 1, spare_border: bool = False) -> np.ndarray:
    """Parts of ``value`` under ``min_pixels`` flipped, those at the image's border spared if asked."""
    labels, n = components(mask == value)
    sizes = np.bincount(labels.ravel(), minlength=n + 1)
    small = sizes < min_pixels
    small[0] = False
    if spare_border:
        small[np.unique(np.concatenate([labels[0], labels[-1], labels[:, 0], labels[:, -1]]))] = False
    return np.where(small[labels], 1 - value, mask).astype(np.uint8)


def filled(mask: np.ndarray) -> np.ndarray:
    """Holes not connected to the border filled."""
    return without_small(mask, mask.size + 1, 0, spare_border=True)


def without_stragglers(mask: np.ndarray) -> np.ndarray:
    """Inner pixels with at most two of eight neighbours peeled off until none is left."""
    m = (mask > 0).astype(np.uint8)
    while True:
        p = np.pad(m, 1)
        n = sum(p[i : i + m.shape[0], j : j + m.shape[1]] for i in range(3) for j in range(3)) - m
        loose = (m == 1) & (n <= 2)
        loose[[0, -1], :] = False
        loose[:, [0, -1]] = False
        if not loose.any():
            return m
        m[loose] = 0


def islands(mask: np.ndarray, min_area: int, ignore_border: bool = True) -> list[tuple[np.ndarray, tuple[int, int], int, bool]]:
    """(crop with one pixel of margin, (column, row) of its origin, area, touches border) of each large enough part."""
    labels, n = components(mask)
    out = []
    areas = np.bincount(labels.ravel(), minlength=n + 1)
    for k in range(1, n + 1):
        if areas[k] < min_area:
            continue
        ys, xs = np.nonzero(labels == k)
        touches = bool(ys.min() == 0 or xs.min() == 0 or ys.max() == mask.shape[0] - 1 or xs.max() == mask.shape[1] - 1)
        if touches and ignore_border:
            continue
        crop = (labels[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1] == k).astype(np.uint8)
        out.append((np.pad(crop, 1), (int(xs.min()) - 1, int(ys.min()) - 1), int(areas[k]), touches))
    return out


# -- size, quality, likeness


def resized(img: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, pixel centres aligned."""
    y = np.clip((np.arange(height) + 0.5) * img.shape[0] / height - 0.5, 0, img.shape[0] - 1)
    x = np.clip((np.arange(width) + 0.5) * img.shape[1] / width - 0.5, 0, img.shape[1] - 1)
    a, b = np.floor(y).astype(int), np.floor(x).astype(int)
    a1, b1 = np.minimum(a + 1, img.shape[0] - 1), np.minimum(b + 1, img.shape[1] - 1)
    fy, fx = (y - a)[:, None], (x - b)[None, :]
    f = img.astype(float)
    return f[a][:, b] * (1 - fy) * (1 - fx) + f[a][:, b1] * (1 - fy) * fx + f[a1][:, b] * fy * (1 - fx) + f[a1][:, b1] * fy * fx


def normalised_piece(mask: np.ndarray, target: int = 500) -> np.ndarray:
    """A mask scaled so that its longer side is ``target`` (left alone within 1 %), smoothed, the largest part kept."""
    ys, xs = np.nonzero(mask)
    if not len(ys):
        return mask
    crop = np.pad(mask[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1], 2)
    scale = target / max(crop.shape)
    if abs(scale - 1) >= 0.01:
        crop = (resized(crop, round(crop.shape[0] * scale), round(crop.shape[1] * scale)) > 0.5).astype(np.uint8)
    return largest_component(closed(opened(crop, 3), 3))


def quality(img: np.ndarray) -> dict:
    """Sharpness 0..100, brightness, contrast and what is wrong."""
    f = img.astype(float)
    lap = f[1:-1, :-2] + f[1:-1, 2:] + f[:-2, 1:-1] + f[2:, 1:-1] - 4 * f[1:-1, 1:-1]
    q = {"blur": float(np.clip(lap.var() / 10, 0, 100)) if lap.size else 0.0, "brightness": float(f.mean()), "contrast": float(f.std() / 1.28)}
    q["issues"] = [n for n, bad in (("blurry", q["blur"] < 10), ("too dark", q["brightness"] < 30), ("too bright", q["brightness"] > 225), ("low contrast", q["contrast"] < 15)) if bad]
    return q


def reject_reason(mask: np.ndarray, min_pixels: int = 50, max_pixels: int | None = None) -> str | None:
    n = int(mask.sum())
    if n == 0:
        return "empty"
    if n < min_pixels:
        return "too small"
    if max_pixels is not None and n > max_pixels:
        return "too large"
    ys, xs = np.nonzero(mask)
    h, w = np.ptp(ys) + 1, np.ptp(xs) + 1
    return "too long" if max(h, w) / min(h, w) > 10 else None


def perceptual_hash(img: np.ndarray) -> int:
    """64 bits: signs of the lowest cosine terms against their median."""
    s = resized(img, 32, 32)
    k = np.arange(32)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / 64)[:8]
    low = (basis @ s @ basis.T).ravel()
    bits = low > np.median(low)
    return int(np.packbits(bits).view(">i8")[0])


def correlation(a: np.ndarray, b: np.ndarray, overlap: np.ndarray, least: int = 500) -> float:
    """Normalised cross-correlation over an overlap, four places; -1 where it is too small or flat."""
    m = overlap > 0
    if m.sum() < least:
        return -1.0
    x, y = a[m].astype(float), b[m].astype(float)
    x, y = x - x.mean(), y - y.mean()
    d = np.sqrt((x * x).sum() * (y * y).sum())
    return round(float((x * y).sum() / d), 4) if d > 0 else -1.0


def homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The projective map of four points onto four."""
    rows, rhs = [], []
    for (x, y), (u, v) in zip(src, dst):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        rhs += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(rhs, float)), 1).reshape(3, 3)


def warped(img: np.ndarray, m: np.ndarray, height: int, width: int) -> np.ndarray:
    """Nearest-pixel warp by a projective map; zero outside."""
    ys, xs = np.mgrid[:height, :width]
    p = np.linalg.inv(m) @ np.stack([xs.ravel(), ys.ravel(), np.ones(xs.size)])
    x, y = np.rint(p[0] / p[2]).astype(int), np.rint(p[1] / p[2]).astype(int)
    ok = (x >= 0) & (y >= 0) & (x < img.shape[1]) & (y < img.shape[0])
    out = np.zeros((height * width, *img.shape[2:]), img.dtype)
    out[ok] = img[y[ok], x[ok]]
    return out.reshape(height, width, *img.shape[2:])


# -- files


def write_bmp(mask: np.ndarray) -> bytes:
    """A mask as a one-bit BMP, rows bottom up, 1 white."""
    h, w = mask.shape
    row = (w + 31) // 32 * 4
    bits = np.packbits(np.pad((mask[::-1] > 0).astype(np.uint8), ((0, 0), (0, row * 8 - w))), axis=1).tobytes()
    head = np.array([40, w, h], "<u4").tobytes() + np.array([1, 1], "<u2").tobytes() + np.array([0, len(bits), 2835, 2835, 2, 2], "<u4").tobytes()
    return b"BM" + np.array([62 + len(bits), 0, 62], "<u4").tobytes() + head + b"\0\0\0\0\xff\xff\xff\0" + bits


def read_bmp(data: bytes) -> np.ndarray:
    """A one-bit BMP as a 0/1 mask."""
    at, w, h = (int(np.frombuffer(data, "<u4", 1, k)[0]) for k in (10, 18, 22))
    row = (w + 31) // 32 * 4
    bits = np.unpackbits(np.frombuffer(data, np.uint8, row * h, at).reshape(h, row), axis=1)
    return bits[::-1, :w].copy()


def exif_orientation(data: bytes) -> int | None:
    """The orientation tag of a JPEG, if it has one."""
    at = 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF:
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            t = data[at + 10 : at + 2 + size]
            order = "little" if t[:2] == b"II" else "big"
            num = lambda k, n: int.from_bytes(t[k : k + n], order)
            first = num(4, 4)
            for k in range(num(first, 2)):
                entry = first + 2 + 12 * k
                if num(entry, 2) == 0x0112:
                    return num(entry + 8, 2)
        at += 2 + size
    return None


# -- whole photos


def cropped_to_content(img: np.ndarray, margin: float = 0.02) -> np.ndarray:
    """The box of what is darker than the background by Otsu's level, with a margin; all of it where nothing stands out."""
    ys, xs = np.nonzero(img <= otsu(img)) if img.min() < img.max() else ((), ())
    if not len(ys):
        return img
    a, b = int(img.shape[0] * margin), int(img.shape[1] * margin)
    return img[max(0, ys.min() - a) : ys.max() + 1 + a, max(0, xs.min() - b) : xs.max() + 1 + b]


def shrunk(img: np.ndarray, most: int = 2000) -> np.ndarray:
    """No side longer than ``most``; smaller images stay as they are."""
    k = most / max(img.shape)
    return img if k >= 1 else np.rint(resized(img, max(1, round(img.shape[0] * k)), max(1, round(img.shape[1] * k)))).astype(img.dtype)


def perspective_corrected(img: np.ndarray, corners: np.ndarray, height: int, width: int) -> np.ndarray:
    """The quadrilateral of four corners (clockwise from the top left) as a rectangle."""
    goal = np.array([[0, 0], [width - 1, 0], [width - 1, height - 1], [0, height - 1]], float)
    return warped(img, homography(corners, goal), height, width)


def split_oversized(mask: np.ndarray, typical: float) -> list[np.ndarray]:
    """A part far over the typical size eroded step by step until it falls into parts of usual size; else the part itself."""
    for size in range(3, 14, 2):
        labels, n = components(eroded(mask, size, True))
        parts = [(labels == k + 1).astype(np.uint8) for k in range(n)]
        if n >= 2 and all(max(np.ptp(v) + 1 for v in np.nonzero(p)) < 1.5 * typical for p in parts):
            return [dilated(p, size, True) & mask for p in parts]
    return [mask]


def most_parts(mask: np.ndarray, least: int = 500, enough: int = 30) -> np.ndarray:
    """Of erosions by growing kernels, the one with the most parts of at least ``least`` pixels; the search ends at ``enough``."""
    best, most = mask, -1
    for size in range(3, 24, 2):
        m = eroded(mask, size, True)
        labels, n = components(m)
        k = int((np.bincount(labels.ravel(), minlength=n + 1)[1:] >= least).sum())
        if k > most:
            best, most = m, k
        if most > enough:
            break
    return best


def white_share(img: np.ndarray, level: int = 150) -> float:
    return float((img > level).mean())


def luminance_counts(img: np.ndarray) -> np.ndarray:
    return np.bincount(img.ravel(), minlength=256)


def mean_squared_difference(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of squared differences over the number of rows, the smaller image padded with zeros."""
    h, w = max(a.shape[0], b.shape[0]), max(a.shape[1], b.shape[1])
    x, y = (np.pad(v.astype(float), ((0, h - v.shape[0]), (0, w - v.shape[1]))) for v in (a, b))
    return float(((x - y) ** 2).sum() / h)


def contrast(img: np.ndarray, mask: np.ndarray, least: int = 100) -> float:
    """Deviation of gray under a mask; 0 where it is too small."""
    v = img[mask > 0]
    return float(v.std()) if len(v) >= least else 0.0
