"""Chart of an increment: growth curves and yearly differences."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import increment


def tables(books: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two tidy tables of the chart: (t, date, baseline_nav, combined_nav) and (year, baseline, combined, delta)."""
    return increment.curves(books), increment.yearly(books)


def plot_increment(books: DataFrame, path: str, title: str = "") -> str:
    """Writes a PNG; needs matplotlib. Labels beyond Latin need a font that has them, and raise ValueError without one."""
    import matplotlib

    matplotlib.use("Agg")
    import matplotlib.pyplot as plt
    from matplotlib import font_manager

    if any("⺀" <= c <= "鿿" for c in title):
        fonts = [f.name for f in font_manager.fontManager.ttflist if any(k in f.name for k in ("CJK", "Hei", "Song", "Ming"))]
        if not fonts:
            raise ValueError("no installed font can draw the title")
        plt.rcParams["font.family"] = fonts[0]
    curves, yearly = (d.toPandas() for d in tables(books))  # one row a date, one row a year
    curves, yearly = curves.sort_values("t"), yearly.sort_values("year")
    figure, (top, low) = plt.subplots(2, 1, figsize=(9, 7))
    top.plot(curves["date"], curves["baseline_nav"], label="baseline")
    top.plot(curves["date"], curves["combined_nav"], label="combined")
    top.legend()
    top.set_title(title)
    low.bar(yearly["year"], yearly["delta"])
    low.axhline(0, lw=0.8)
    figure.savefig(path, dpi=120)
    plt.close(figure)
    return path
