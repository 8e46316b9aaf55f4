"""Scalar and array expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The notes by letter, and the names of the twelve pitch classes.
NOTES = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}
NAMES = ["C", "C#", "D", "Eb", "E", "F", "F#", "G", "Ab", "A", "Bb", "B"]
QUALITIES = ["", "m", "aug", "dim"]
#: The intervals of major, minor, augmented and diminished triads.
TRIADS = [(0, 4, 7), (0, 3, 7), (0, 4, 8), (0, 3, 6)]


def pitch_class(label: Column) -> Column:
    """0 to 11 for a chord name's root letter, one more for a sharp and one less for a flat after it (so "Cb" is -1); null for no letter."""
    letter = F.element_at(F.create_map(*[F.lit(x) for kv in NOTES.items() for x in kv]), F.substring(label, 1, 1))
    sign = F.substring(label, 2, 1)
    return letter + F.when(sign == "b", -1).when(sign == "#", 1).otherwise(0)


def triad_quality(label: Column) -> Column:
    """3 for a name with "dim", else 2 with "aug", else 1 with "m", else 0."""
    return F.when(F.contains(label, F.lit("dim")), 3).when(F.contains(label, F.lit("aug")), 2).when(F.contains(label, F.lit("m")), 1).otherwise(0)


def chord_index(label: Column) -> Column:
    """Pitch class plus twelve times the quality."""
    return pitch_class(label) + 12 * triad_quality(label)


def chord_name(index: Column) -> Column:
    """A name for an index of chord_index."""
    at = lambda xs, k: F.element_at(F.array(*[F.lit(x) for x in xs]), (k + 1).cast("int"))
    return F.concat(at(NAMES, F.pmod(index, F.lit(12))), at(QUALITIES, F.floor(index / 12)))


def chord_pitches(index: Column) -> Column:
    """The sorted pitch classes of an index's triad."""
    triads = F.array(*[F.array(*[F.lit(x) for x in t]) for t in TRIADS])
    return F.array_sort(F.transform(F.element_at(triads, (F.floor(index / 12) + 1).cast("int")), lambda x: F.pmod(x + index, F.lit(12))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(F.try_divide(dot(a, b), n))


def chi_squared(a: Column, b: Column) -> Column:
    """Half the sum of squared differences over sums, which are a millionth larger so that empty bins divide."""
    return F.lit(0.5) * F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y) / (x + y + 1e-6)), F.lit(0.0), lambda s, x: s + x)


def sample_coefficient(mean: Column, deviation: Column) -> Column:
    """Deviation over mean, null for a mean of zero."""
    return F.try_divide(deviation, mean)


def tonal_complexity(chroma: Column) -> Column:
    """How far twelve pitch-class weights, along the circle of fifths, are from one direction: root of one minus the length of the mean direction of the normalised weights; null without weight."""
    total = F.aggregate(chroma, F.lit(0.0), lambda s, x: s + x.cast("double"))
    at = lambda k: F.element_at(chroma, F.lit(7 * k % 12 + 1)).cast("double")
    import math

    re = sum((at(k) * math.cos(2 * math.pi * k / 12) for k in range(12)), F.lit(0.0))
    im = sum((at(k) * math.sin(2 * math.pi * k / 12) for k in range(12)), F.lit(0.0))
    r = F.try_divide(F.sqrt(re * re + im * im), total)
    return F.sqrt(F.greatest(F.lit(0.0), 1 - r))


def amplitude(db: Column) -> Column:
    """The amplitude of a level in decibels."""
    return F.pow(F.lit(10.0), db / 20)


def octave(frequency: Column) -> Column:
    """Frequency on a linear scale of octaves."""
    return F.log2(frequency)
