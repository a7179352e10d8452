"""Column expressions: everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SAMPLE_RATE, FRAME = 16000, 512
SPEAKER_LETTERS = "ABCDEFGH"


def let(value: Column, use) -> Column:
    """use(value), with value computed once. A plain expression inside a function over an array is computed for each
    element anew."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


# -- samples ------------------------------------------------------------------------------------------------------
def normalize_frame(samples: Column, n: int = FRAME) -> Column:
    """Exactly n samples: cut, or filled up with zeros."""
    return F.slice(F.concat(samples, F.array_repeat(F.lit(0.0).cast("float"), n)), 1, n)


def mean_square(samples: Column) -> Column:
    return F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) / F.size(samples)


def _db(ms: Column) -> Column:
    return 20 * F.log10(F.sqrt(ms + 1e-12) + 1e-12)


def frame_energy_db(samples: Column) -> Column:
    return _db(mean_square(samples))


def rms_db(ms: Column) -> Column:
    """segment_rms_db by the mean square, which is null without samples."""
    return F.when(ms.isNull(), -100.0).otherwise(_db(ms))


def segment_rms_db(samples: Column) -> Column:
    return F.when(F.coalesce(F.size(samples), F.lit(0)) <= 0, -100.0).otherwise(frame_energy_db(samples))


def live_level_dbfs(samples: Column) -> Column:
    return F.when(F.coalesce(F.size(samples), F.lit(0)) <= 0, -120.0).otherwise(20 * F.log10(F.greatest(F.sqrt(mean_square(samples) + 1e-12), F.lit(1e-6))))


def energy_speech_prob(energy_db: Column) -> Column:
    return 1 / (1 + F.exp(-(energy_db + 38.0) / 5.0))


def input_level(samples: Column) -> Column:
    return F.least(F.lit(1.0), F.sqrt(mean_square(samples)) * 4)


def slice_samples(samples: Column, start: Column, end: Column) -> Column:
    """Samples [start, end), both held within what there is."""
    n = F.size(samples)
    a = F.least(F.greatest(start, F.lit(0)), n)
    b = F.least(F.greatest(end, a), n)
    return F.slice(samples, (a + 1).cast("int"), (b - a).cast("int"))


def mix_at_snr(speech: Column, noise: Column, speech_rms: Column, snr_db: Column) -> Column:
    """Noise of unit loudness scaled to snr_db below the speech and added; a peak above 0.98 is brought down to it."""
    mixed = let(speech_rms / F.pow(F.lit(10.0), snr_db / 20), lambda gain: F.zip_with(speech, noise, lambda s, n: s + n * gain))
    limited = lambda y: let(F.array_max(F.transform(y, F.abs)), lambda peak: F.transform(y, lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x * F.when(peak > 0.98, 0.98 / peak).otherwise(1.0)))))
    return let(mixed, limited)


# -- text ---------------------------------------------------------------------------------------------------------
def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9']+)"), 1)


def assemble_text(parts: Column) -> Column:
    return F.array_join(F.filter(F.transform(parts, F.trim), lambda x: x != ""), " ")


def display_text(turn: Column, segment: Column) -> Column:
    return F.coalesce(F.nullif(turn, F.lit("")), F.nullif(segment, F.lit("")), F.lit("[Speech detected]"))


def asr_confidence(mean_logprob: Column) -> Column:
    return F.when(mean_logprob.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.exp(mean_logprob))))


def partial_wpm(words: Column, text: Column, voiced_s: Column) -> Column:
    """words: number of word rows, 0 where the engine gives none; then the text's own words count."""
    own = F.size(F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != ""))
    return F.when(voiced_s > 0.4, F.when(words > 0, words).otherwise(own) * 60.0 / voiced_s)


# -- display ------------------------------------------------------------------------------------------------------
def format_mmss(seconds: Column) -> Column:
    s = F.when(F.isnan(seconds) | (seconds < 0) | seconds.isNull(), 0.0).otherwise(seconds)
    whole = F.floor(s)
    return F.format_string("%02d:%02d", F.floor(whole / 60), whole % 60)


def format_vtt_time(seconds: Column) -> Column:
    """HH:MM:SS.mmm; milliseconds are cut, not rounded."""
    whole = F.floor(seconds)
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60, F.floor((seconds - whole) * 1000))


def transcript_line(seconds: Column, label: Column, text: Column) -> Column:
    return F.concat(F.lit("["), format_mmss(seconds), F.lit("] "), label, F.lit(": "), text)


def speaker_label(n: Column) -> Column:
    """n counts speakers from 1."""
    letters = F.array(*(F.lit(f"Speaker {c}") for c in SPEAKER_LETTERS))
    return F.when(n <= len(SPEAKER_LETTERS), F.get(letters, (n - 1).cast("int"))).otherwise(F.concat(F.lit("Speaker "), n.cast("string")))


def display_name(label: Column, custom: Column) -> Column:
    return F.when(custom.isNotNull() & (custom != ""), F.concat(custom, F.lit(" ("), label, F.lit(")"))).otherwise(label)


# -- vectors ------------------------------------------------------------------------------------------------------
def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    return let(F.sqrt(dot(v, v)) + 1e-8, lambda norm: F.transform(v, lambda x: x.cast("double") / norm))


def match_confidence(similarity: Column, is_new: Column, is_only: Column) -> Column:
    known = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (similarity + 0.2) / 0.8))
    return F.when(is_new, F.when(is_only, 1.0).otherwise(0.85)).otherwise(known)


# -- pitch and pace -----------------------------------------------------------------------------------------------
def median(values: Column) -> Column:
    """Of an array; null of an empty one."""
    s, n = F.array_sort(values), F.size(values)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def median_filter5(values: Column) -> Column:
    """Five-point median with zeros beyond the ends; fewer than five values stay."""
    zeros = F.array(F.lit(0.0), F.lit(0.0))
    middle = lambda padded: F.transform(F.sequence(F.lit(1), F.size(values)), lambda i: F.get(F.array_sort(F.slice(padded, i, F.lit(5))), F.lit(2)))
    return F.when(F.size(values) < 5, values).otherwise(let(F.concat(zeros, values, zeros), middle))


def semitones(high: Column, low: Column) -> Column:
    return 12 * F.log2(high / low)


def pitch_range_semitones(low: Column, high: Column) -> Column:
    return F.when(low > 0, semitones(high, low))


def contour_excursion(values: Column) -> Column:
    """Semitones from the first 60 % of a contour to the rest, by medians; null for fewer than four values."""
    cut = F.greatest(F.lit(2), F.floor(F.size(values) * 0.6).cast("int"))
    head, tail = median(F.slice(values, F.lit(1), cut)), median(F.slice(values, cut + 1, F.greatest(F.size(values) - cut, F.lit(1))))
    return F.when((F.size(values) >= 4) & (head > 0), semitones(tail, head))


def speech_rate(n_words: Column, seconds: Column) -> Column:
    per_s = n_words / seconds
    known = (n_words > 0) & (seconds > 0.4)
    return F.when(known & (per_s >= 3.6), "fast").when(known & (per_s <= 1.6) & (n_words >= 2), "slow").otherwise("normal")


def words_per_minute(n_words: Column, seconds: Column) -> Column:
    return F.when((n_words > 0) & (seconds > 0.4), n_words * 60.0 / seconds)


def relative_volume(rms_db: Column, baseline_db: Column | None = None) -> Column:
    if baseline_db is None:
        return F.when(rms_db > -18, "loud").when(rms_db < -32, "quiet").otherwise("normal")
    return F.when(rms_db - baseline_db > 4.5, "loud").when(rms_db - baseline_db < -5, "quiet").otherwise("normal")


def direction(change: Column, pitch: Column) -> Column:
    """change: semitones against the history (null: none yet)."""
    return F.when(pitch.isNull(), "unavailable").when(change >= 1.2, "rising").when(change <= -1.2, "falling").otherwise("steady")
