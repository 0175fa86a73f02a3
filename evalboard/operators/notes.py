"""Two clips of notes of which one attribute differs, as arrays of structs, and their layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Melody notes (onset, pitch, duration) and chords (onset, pitches, duration) of the first clip.
MELODY = ((0, 7, 2), (2, 9, 2), (4, 11, 2), (6, 9, 1), (7, 7, 1), (8, 6, 2), (10, 7, 2), (12, 9, 4))
CHORDS = ((0, (0, 2), 8), (8, (1, 3), 8))
MOVED_NOTE, MOVED_CHORD, TEMPO = (4, (7, 12, 1)), (1, (8, (0, 4), 8)), 0.8
#: Fixed values of the drawing.
WIDTH, LANE, GAP, TOP, LEFT, RIGHT, STEPS, ROWS, BAR = 520, 150, 18, 4, 44, 12, 16, 13, 4
#: Changes of a test item, in cents, by tempo ratio, by instrument.
GRID = {"melody": ("100", "200", "400", "700"), "rhythm": ("1.10", "1.20", "1.35", "1.50"), "timbre": ("piano", "guitar", "violin", "flute"), "harmony": ("100", "200", "300")}

CLIP = "clip string, melody array<struct<onset:double,pitch:int,dur:double>>, chords array<struct<onset:double,pitches:array<int>,dur:double>>"


def first_clip(spark: SparkSession) -> DataFrame:
    melody = [(float(t), p, float(d)) for t, p, d in MELODY]
    chords = [(float(t), list(ps), float(d)) for t, ps, d in CHORDS]
    return spark.createDataFrame([("A", melody, chords)], CLIP)


def replaced(notes: Column, at: int, note: Column) -> Column:
    """The array with another element at an index from 0."""
    return F.transform(notes, lambda x, i: F.when(i == at, note).otherwise(x))


def scaled(notes: Column, pitch: str, factor: float) -> Column:
    """Onsets and durations times the factor."""
    return F.transform(notes, lambda x: F.struct((x["onset"] * factor).alias("onset"), x[pitch].alias(pitch), (x["dur"] * factor).alias("dur")))


def _note(onset: int, pitch: int | tuple[int, ...], dur: int) -> Column:
    value = F.lit(pitch).alias("pitch") if isinstance(pitch, int) else F.array(*[F.lit(p) for p in pitch]).alias("pitches")
    return F.struct(F.lit(float(onset)).alias("onset"), value, F.lit(float(dur)).alias("dur"))


def clips_of(rows: DataFrame, key: str, values: Column) -> DataFrame:
    """A clip for each row, from an array of twelve numbers or more: eight notes and two chords of two, whose pitches are the numbers' hundredths modulo the rows of the drawing."""
    pitch = lambda i: F.pmod(F.floor(F.element_at(values, i).cast("double") * 100), F.lit(ROWS)).cast("int")
    melody = F.array(*[F.struct(F.lit(2.0 * i).alias("onset"), pitch(i + 1).alias("pitch"), F.lit(2.0).alias("dur")) for i in range(8)])
    chords = F.array(*[F.struct(F.lit(8.0 * i).alias("onset"), F.array(pitch(9 + 2 * i), pitch(10 + 2 * i)).alias("pitches"), F.lit(8.0).alias("dur")) for i in range(2)])
    return rows.select(F.col(key), F.lit("A").alias("clip"), melody.alias("melody"), chords.alias("chords"))


def variant(clips: DataFrame, attribute: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """The second clip of each: melody, chords, the indexes that changed, and whether the timbre did; keys are columns that tell clips apart."""
    melody, chords = F.col("melody"), F.col("chords")
    every = {"melody": F.transform("melody", lambda _, i: i), "chords": F.transform("chords", lambda _, i: i)}
    none = F.array().cast("array<int>")
    changed = {"melody": none, "chords": none}
    if attribute == "melody":
        melody, changed["melody"] = replaced(melody, MOVED_NOTE[0], _note(*MOVED_NOTE[1])), F.array(F.lit(MOVED_NOTE[0]))
    elif attribute == "harmony":
        chords, changed["chords"] = replaced(chords, MOVED_CHORD[0], _note(*MOVED_CHORD[1])), F.array(F.lit(MOVED_CHORD[0]))
    elif attribute == "rhythm":
        melody, chords, changed = scaled(melody, "pitch", TEMPO), scaled(chords, "pitches", TEMPO), every
    elif attribute == "timbre":
        changed = every
    else:
        raise ValueError(f"no such attribute: {attribute}")
    return clips.select(*keys, F.lit("B").alias("clip"), melody.alias("melody"), chords.alias("chords"), changed["melody"].alias("changed_melody"), changed["chords"].alias("changed_chords"), F.lit(attribute == "timbre").alias("timbre"))


def pair(clips: DataFrame, attribute: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Both clips of each with their lanes."""
    none = F.array().cast("array<int>")
    first = clips.select(*keys, "clip", "melody", "chords", none.alias("changed_melody"), none.alias("changed_chords"), F.lit(False).alias("timbre"), F.lit(0).alias("lane"))
    return first.unionByName(variant(clips, attribute, keys).withColumn("lane", F.lit(1)))


def x_of(onset: Column) -> Column:
    return LEFT + onset * (WIDTH - LEFT - RIGHT) / STEPS


def y_of(lane: Column, pitch: Column) -> Column:
    return TOP + lane * (LANE + GAP) + (ROWS - 1 - pitch) * (LANE / ROWS)


def rectangles(clips: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """A row for each note drawn: lane, part, index, pitch, x, y, width, height, and whether it differs from the first clip."""
    melody = clips.select(*keys, "lane", "timbre", F.lit("melody").alias("part"), F.col("changed_melody").alias("changed"), F.posexplode("melody").alias("i", "n"))
    melody = melody.select(*keys, "lane", "timbre", "part", "i", "n.onset", "n.dur", "n.pitch", F.array_contains("changed", F.col("i")).alias("changed"))
    chords = clips.select(*keys, "lane", "timbre", F.lit("chords").alias("part"), F.col("changed_chords").alias("changed"), F.posexplode("chords").alias("i", "n"))
    chords = chords.select(*keys, "lane", "timbre", "part", "i", "n.onset", "n.dur", F.explode("n.pitches").alias("pitch"), F.array_contains("changed", F.col("i")).alias("changed"))
    unit = (WIDTH - LEFT - RIGHT) / STEPS
    return chords.unionByName(melody).select(*keys, "lane", "part", "i", "pitch", (x_of(F.col("onset")) + 2).alias("x"), (y_of(F.col("lane"), F.col("pitch")) + 0.5).alias("y"), (F.col("dur") * unit - 4).alias("width"), F.lit(LANE / ROWS - 1).alias("height"), "changed", (F.col("changed") & F.col("timbre")).alias("hatched"))


def bar_lines(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(BAR), F.lit(STEPS - BAR), F.lit(BAR))).alias("bar")).withColumn("x", x_of(F.col("bar")))


def question(attribute: Column) -> Column:
    return F.when(attribute == "rhythm", F.lit("Which clip is faster?")).otherwise(F.concat(F.lit("Same or different "), attribute, F.lit("?")))


#: What a reader is told about each second clip; other words may be given.
CAPTIONS = {"melody": "B: one note is higher.", "rhythm": "B: faster.", "timbre": "B: another instrument.", "harmony": "B: another second chord."}


def caption(attribute: Column, captions: dict[str, str] | None = None) -> Column:
    said = None
    for name, words in (captions or CAPTIONS).items():
        said = F.when(attribute == name, words) if said is None else said.when(attribute == name, words)
    return said


def item_grid(spark: SparkSession) -> DataFrame:
    """Attribute and change of every kind of test item."""
    return spark.createDataFrame([(a, v) for a, values in GRID.items() for v in values], "attribute string, change string")


def items_of(rows: DataFrame, key: str) -> DataFrame:
    """Every kind of test item for each row: key, attribute and change."""
    grid = F.array(*[F.struct(F.lit(a).alias("attribute"), F.lit(v).alias("change")) for a, values in GRID.items() for v in values])
    return rows.select(key, F.inline(grid))


LABELS = ("Clip A", "Clip B")


def svg(clips: DataFrame, attribute: str) -> DataFrame:
    """One drawing of pair(): for each lane its label, ground and bar lines, then a rect for each note, chords below melody. Notes that changed have the attribute's colour, or stripes
    of it where the timbre did. Names of style classes and variables are fixed values."""
    colour = f"var(--{attribute})"
    stripes = f'<defs><pattern id="stripes" width="6" height="6" patternUnits="userSpaceOnUse"><path d="M-1 1L1 -1M0 6L6 0M5 7L7 5" stroke="{colour}" stroke-width="2"/></pattern></defs>'
    top = F.lit(float(TOP)) + F.col("lane") * (LANE + GAP)
    label = F.format_string('<text class="lane-label" x="0" y="%.1f">%s</text>', top + LANE / 2 + 4, F.element_at(F.array(*map(F.lit, LABELS)), F.col("lane") + 1))
    ground = F.format_string(f'<rect x="{LEFT}" y="%.1f" width="{WIDTH - LEFT - RIGHT}" height="{LANE}" rx="8" fill="var(--paper)"/>', top)
    bars = F.array_join(F.transform(F.sequence(F.lit(BAR), F.lit(STEPS - BAR), F.lit(BAR)), lambda b: F.format_string('<line x1="%.2f" x2="%.2f" y1="%.1f" y2="%.1f" stroke="var(--rule)"/>', x_of(b.cast("double")), x_of(b.cast("double")), top + 4, top + LANE - 4)), "")
    grounds = clips.select("lane", F.lit(0).alias("layer"), F.lit(0).alias("i"), F.lit(0).alias("pitch"), F.concat(label, ground, bars).alias("mark"))
    chord = F.col("part") == "chords"
    fill = F.when(F.col("hatched"), "url(#stripes)").when(F.col("changed"), colour).when(chord, "var(--muted)").otherwise("var(--ink)")
    opacity = F.when(chord, F.when(F.col("changed"), ' opacity=".9"').otherwise(' opacity=".28"')).otherwise("")
    note = F.format_string('<rect class="note" x="%.2f" y="%.2f" width="%.2f" height="%.2f" rx="3" fill="%s"%s/>', "x", "y", "width", "height", fill, opacity)
    notes = rectangles(clips).select("lane", F.when(chord, 1).otherwise(2).alias("layer"), "i", "pitch", note.alias("mark"))
    one = grounds.unionByName(notes).agg(F.array_sort(F.collect_list(F.struct("lane", "layer", "i", "pitch", "mark"))).alias("m"))  # a few notes
    return one.select(F.concat(F.lit(f'<svg viewBox="0 0 {WIDTH} {TOP * 2 + LANE * 2 + GAP}">{stripes}'), F.array_join(F.transform("m", lambda v: v["mark"]), ""), F.lit("</svg>")).alias("svg"))
