"""Clips and their drawing."""

from __future__ import annotations

import pytest

from evalboard.operators import notes as N


@pytest.mark.parametrize(("attribute", "n_changed"), [("melody", 1), ("rhythm", 12), ("timbre", 12), ("harmony", 2)])
def test_pair(spark, attribute, n_changed):
    rects = N.rectangles(N.pair(N.first_clip(spark), attribute))
    rows = rects.collect()
    assert len(rows) == 24 and sum(r["changed"] for r in rows) == n_changed and not any(r["changed"] for r in rows if r["lane"] == 0)
    assert any(r["hatched"] for r in rows) == (attribute == "timbre")
    drawing = N.svg(N.pair(N.first_clip(spark), attribute), attribute).first()[0]
    assert drawing.count('<rect class="note"') == 24 and drawing.count("<line") == 6 and drawing.count("<rect x=") == 2 and "Clip A" in drawing and "Clip B" in drawing
    assert drawing.count(f"var(--{attribute})\" opacity") + drawing.count(f"var(--{attribute})\"/>") == (0 if attribute == "timbre" else n_changed) and drawing.count("url(#stripes)") == (12 if attribute == "timbre" else 0)
    assert drawing.index("Clip A") < drawing.index("Clip B") and drawing.startswith('<svg viewBox="0 0 520 326">')


def test_values(spark):
    b = N.variant(N.first_clip(spark), "rhythm").first()
    assert b["melody"][1]["onset"] == pytest.approx(1.6) and b["melody"][1]["dur"] == pytest.approx(1.6)
    b = N.variant(N.first_clip(spark), "melody").first()
    assert tuple(b["melody"][4]) == (7.0, 12, 1.0) and tuple(b["melody"][3]) == (6.0, 9, 1.0)
    b = N.variant(N.first_clip(spark), "harmony").first()
    assert b["chords"][1]["pitches"] == [0, 4]
    with pytest.raises(ValueError):
        N.variant(N.first_clip(spark), "volume")


def test_layout(spark):
    from pyspark.sql import functions as F

    assert [(r["bar"], r["x"]) for r in N.bar_lines(spark).collect()] == [(4, 160.0), (8, 276.0), (12, 392.0)]
    assert spark.range(1).select(N.question(F.lit("rhythm")), N.question(F.lit("harmony"))).first()[1] == "Same or different harmony?"
    assert "faster" in spark.range(1).select(N.caption(F.lit("rhythm"))).first()[0]
    assert N.item_grid(spark).count() == 15
