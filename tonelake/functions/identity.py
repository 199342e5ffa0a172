"""Names, labels and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signal types by the names they go by.
SIGNAL_TYPES = {
    "tone": "tone", "two-tone": "two_tone", "twotone": "two_tone", "sweep": "sweep", "white-noise": "white_noise", "white_noise": "white_noise", "whitenoise": "white_noise",
    "pink-noise": "pink_noise", "pink_noise": "pink_noise", "pinknoise": "pink_noise", "m-noise": "m_noise", "m_noise": "m_noise", "mnoise": "m_noise",
    "mls": "mls", "maximum-length-sequence": "mls", "maximum_length_sequence": "mls", "maximumlengthsequence": "mls", "dirac": "dirac", "impulse": "dirac", "stipa": "stipa", "sti-pa": "stipa",
}
#: What to do about a capture error, by what its text has.
ADVICE = (
    (("permission", "denied", "not authorized"), "Check the OS microphone privacy settings, then restart the app."),
    (("busy", "in use", "exclusive"), "The device is busy — close other apps using it and try again."),
    (("not found", "no such device", "no default input device", "no default output device"), "Run with --list-devices (or the UI device picker) to see available devices."),
)


def safe_name(name: Column) -> Column:
    """Letters, digits, _ and - stay, anything else is _; what is empty is "recording"."""
    return F.coalesce(F.nullif(F.regexp_replace(F.trim(name), r"[^\p{L}\p{N}_-]", "_"), F.lit("")), F.lit("recording"))


def safe_ascii_name(name: Column) -> Column:
    """ASCII letters, digits, _, - and . stay; null for a name of nothing or of dots only."""
    clean = F.regexp_replace(name, "[^A-Za-z0-9_.-]", "_")
    return F.when(~clean.rlike(r"^\.*$"), clean)


def portable_name(name: Column) -> Column:
    """Whether a name is one path component that any file system takes."""
    return name.rlike(r"^[A-Za-z0-9_][A-Za-z0-9_.-]{0,127}$") & ~name.rlike(r"\.$")


def signal_type(name: Column) -> Column:
    """The signal type of a name in any case; null for an unknown one."""
    known = F.create_map(*[F.lit(x) for kv in SIGNAL_TYPES.items() for x in kv])
    return F.try_element_at(known, F.lower(name))


def capture_type(name: Column) -> Column:
    """The signal type that a capture plays, which is a sweep where the name is none of them."""
    return F.coalesce(signal_type(name), F.lit("sweep"))


def _label(text: Column) -> Column:
    """A string as its length in eight bytes, and its bytes."""
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(text)), 16, "0")), F.encode(text, "UTF-8"))


def take_id(source: Column, microphone: Column, repeat: Column) -> Column:
    """An id that the take's place in its session determines, whatever characters the labels have."""
    digest = F.sha2(F.concat(F.unhex(F.lpad(F.hex(repeat), 8, "0")), _label(source), _label(microphone)), 256)
    return F.concat(F.format_string("take-r%03d-", repeat), digest)


def channel_list(text: Column) -> Column:
    """Channels of a text like "0,1,2"; null if one is no number below 64, or twice there."""
    found = F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("int"))
    ok = F.forall(found, lambda x: x.isNotNull() & (x >= 0) & (x < 64)) & (F.size(F.array_distinct(found)) == F.size(found))
    return F.when(ok, found)


def band_label(lo: Column, hi: Column) -> Column:
    """``sweep_lo_hi`` in whole Hz, halves to even."""
    whole = lambda x: F.bround(x, 0).cast("long").cast("string")
    return F.concat(F.lit("sweep_"), whole(lo), F.lit("_"), whole(hi))


def filename(prefix: Column, kind: Column, send: Column, receive: Column, rate: Column) -> Column:
    return F.concat_ws("_", prefix, kind, F.concat(F.lit("send"), send), F.concat(F.lit("rec"), receive), rate.cast("string"))


def capture_advice(context: Column, error: Column) -> Column:
    """A capture error with what to do about it, where its text tells, and always with the text itself."""
    low = F.lower(error)
    advice = F.coalesce(*[F.when(_any(low, parts), F.lit(text)) for parts, text in ADVICE])
    plain = F.concat(context, F.lit(": "), error)
    return F.coalesce(F.concat(context, F.lit(": "), advice, F.lit(" (original error: "), error, F.lit(")")), plain)


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | text.contains(part)
    return found
