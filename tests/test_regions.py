"""Reading order of nested layouts with a known order, and lines of glyphs."""

import random

from palimpsest.operators import regions

BLOCKS = "document string, page long, block long, x0 double, y0 double, x1 double, y1 double, width double, height double, text string"


def nested(rng, x0, y0, x1, y1, gap, depth, out):
    """Blocks of a random layout, in reading order: regions are parted by strips that get narrower with depth."""
    across = rng.random() < 0.5
    size, least = (x1 - x0, 30.0) if across else (y1 - y0, 40.0)
    n = rng.randint(2, 3)
    part = (size - (n - 1) * gap) / n
    if depth == 0 or part < least:
        out.append((x0, y0, x1, y1))
        return
    for k in range(n):
        a = k * (part + gap)
        box = (x0 + a, y0, x0 + a + part, y1) if across else (x0, y0 + a, x1, y0 + a + part)
        nested(rng, *box, gap * 0.6, depth - 1, out)


def test_nested_layouts_are_read_in_order(spark):
    rng, rows, want = random.Random(8), [], {}
    for page in range(1, 31):
        boxes = []
        nested(rng, 50.0, 50.0, 950.0, 1250.0, 90.0, rng.randint(1, 4), boxes)
        want[page] = [f"t{k}" for k in range(len(boxes))]
        own = [("d", page, k, *b, 1000.0, 1300.0, f"t{k}") for k, b in enumerate(boxes)]
        rng.shuffle(own)
        rows += [(*r[:2], n, *r[3:]) for n, r in enumerate(own)]
    got = {r.page: r.text.split("\n") for r in regions.page_text(spark.createDataFrame(rows, BLOCKS)).collect()}
    assert got == want


def test_side_bars_titles_and_glyphs(spark):
    def block(n, x0, y0, x1, y1, text):
        return ("d", 1, n, x0, y0, x1, y1, 600.0, 800.0, text)

    page = [block(0, 50.0, 20.0, 550.0, 60.0, "TITLE"), block(1, 50.0, 100.0, 250.0, 700.0, "left"), block(2, 300.0, 100.0, 420.0, 380.0, "box"), block(3, 440.0, 100.0, 550.0, 380.0, "bar"), block(4, 300.0, 420.0, 550.0, 700.0, "right")]
    glyphs = [block(10 + k, 50.0 + x, 750.0 + k % 2, 58.0 + x, 760.0 + k % 2, c) for k, (x, c) in enumerate([(0, "a"), (9, "b"), (25, "c"), (34, "d")])]
    odd = [block(20, 5.0, 5.0, 5.0, 9.0, "flat"), block(21, 1.0, 1.0, 2.0, 2.0, " "), ("d", 1, 22, None, 1.0, 2.0, 2.0, 600.0, 800.0, "null"), ("e", 1, 0, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0, "none")]
    got = {(r.document, r.page): r.text for r in regions.page_text(spark.createDataFrame([*reversed(page), *glyphs[::-1], *odd], BLOCKS)).collect()}
    assert got == {("d", 1): "TITLE\nleft\nbox\nbar\nright\nab cd"}
    assert regions.page_text(spark.createDataFrame([], BLOCKS)).collect() == []
