"""Transcript files, audio files, speech-to-text output folders and settings as sources."""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Callable
from typing import Protocol
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from confab.functions.payload import batch_failure, parse_speech
from confab.functions.text import normalise, suffix
from confab.operators.segments import parse_segments, plain_transcript
from confab.sources.tables import hadoop_path, read_text, written

TRANSCRIPT_SUFFIXES = ("docx", "pdf", "txt")
#: Clips below this go the direct way.
SHORT_SECONDS = 30.0
AUDIO_SUFFIXES = ("aac", "m4a", "mp3", "mp4", "wav")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def decode_text(data: bytes) -> str:
    """UTF-8 (without its mark), else UTF-16, else Windows-1252."""
    for encoding in ("utf-8-sig", "utf-16", "cp1252"):
        try:
            return data.decode(encoding)
        except UnicodeError:
            continue
    raise ValueError("Text encoding is not supported.")


def docx_text(data: bytes) -> str:
    """Non-blank paragraphs, then tables a row per line, cells joined by a bar."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")

    def words(p) -> str:
        return "".join({f"{_W}t": x.text or "", f"{_W}tab": "\t", f"{_W}br": "\n"}.get(x.tag, "") for x in p.iter())

    lines = [t for p in body.findall(f"{_W}p") if (t := words(p)).strip()]
    for row in (r for t in body.findall(f"{_W}tbl") for r in t.findall(f"{_W}tr")):
        cells = ["\n".join(words(p) for p in c.findall(f"{_W}p")).strip() for c in row.findall(f"{_W}tc")]
        if line := " | ".join(c for c in cells if c):
            lines.append(line)
    return "\n".join(lines)


def pdf_text(data: bytes) -> str:
    """Text of non-blank pages, a blank line between them; needs the optional PDF library."""
    from pypdf import PdfReader

    pages = [(p.extract_text() or "").strip() for p in PdfReader(io.BytesIO(data)).pages]
    return "\n\n".join(p for p in pages if p)


# The messages of this function and of those below for files that are refused.
def extract(kind: str, data: bytes) -> tuple[str | None, str | None]:
    """(text, error) of one file's bytes."""
    if kind not in TRANSCRIPT_SUFFIXES:
        return None, "Unsupported transcript file type."
    if not data:
        return None, "The uploaded transcript file is empty."
    try:
        return {"txt": decode_text, "docx": docx_text, "pdf": pdf_text}[kind](data), None
    except ImportError:
        return None, "PDF support is not installed."
    except Exception as e:  # noqa: BLE001  a damaged file is that row's error
        return None, f"The file could not be read: {e}"


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def transcripts_of_files(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(``path``, ``keep``, ``text``, ``segments``, ``transcript``, ``error``) of rows of the binary-file source.

    Spark's file source lists no empty files; rows without content are reported as such.
    Plain UTF-8 text never leaves the JVM; only other encodings and document formats go to Python.
    """
    names = ["path", *keep]
    src = files.select(*names, suffix(F.col("path")).alias("kind"), "content")
    plain = (F.col("kind") == "txt") & (F.length("content") > 0) & F.is_valid_utf8(F.col("content").cast("string"))
    native = src.where(plain).select(*names, F.regexp_replace(F.col("content").cast("string"), "^\ufeff", "").alias("raw"), F.lit(None).cast("string").alias("error"))

    def run(batches):
        import pandas as pd

        for b in batches:
            got = [extract(k, bytes(c)) for k, c in zip(b["kind"], b["content"])]
            yield pd.DataFrame({**{n: b[n] for n in names}, "raw": [t for t, _ in got], "error": [e for _, e in got]})

    rest = src.where(~plain).mapInPandas(run, native.schema)
    return parsed_texts(native.unionByName(rest), names)


def parsed_texts(rows: DataFrame, names: list[str]) -> DataFrame:
    """The texts (``raw``) normalised and parsed, with what is wrong with them."""
    text = rows.select(*names, normalise(F.col("raw")).alias("text"), "error")
    error = F.coalesce("error", F.when(F.coalesce("text", F.lit("")) == "", F.lit("No readable text was found in the transcript file.")))
    out = text.select(*names, "text", error.alias("error"), F.when(error.isNull(), parse_segments(F.col("text"))).alias("segments"))
    return out.select(*names, "text", "segments", F.when(F.col("error").isNull(), plain_transcript(F.col("text"), F.col("segments"))).alias("transcript"), "error")


def audio_files(files: DataFrame) -> DataFrame:
    """Audio rows with ``kind`` and ``error`` for empty or unsupported ones."""
    kind = suffix(F.col("path"))
    return files.select("*", kind.alias("kind"), audio_error(F.col("path"), F.col("length")).alias("error"))


def audio_error(path: Column, length: Column) -> Column:
    """Why a file is no audio source; null if it is one."""
    kind = suffix(path)
    known = ", ".join(f".{s}" for s in sorted(AUDIO_SUFFIXES))
    shown = F.when(kind != "", F.concat(F.lit("."), kind)).otherwise(F.lit("unknown"))
    return F.when(F.coalesce(length, F.lit(0)) == 0, F.lit("The audio file is empty.")).when(~kind.isin(*AUDIO_SUFFIXES), F.concat(F.lit("Unsupported audio format '"), shown, F.lit(f"'. Supported formats: {known}.")))


class Converter(Protocol):
    """Turns audio of any supported kind into WAV (16-bit PCM, first audio stream)."""

    def to_wav(self, data: bytes, kind: str) -> bytes: ...


def converted(files: DataFrame, factory: Callable[[], Converter]) -> DataFrame:
    """(``path``, ``wav``, ``error``) of audio files, by a converter made once a partition; nothing is converted twice."""
    src = audio_files(files).select("path", "kind", "content", "error")

    def run(batches):
        import pyarrow as pa

        tool = None
        for b in batches:
            paths, out = b.column(0).to_pylist(), []
            for kind, content, error in zip(*(b.column(k).to_pylist() for k in (1, 2, 3))):
                wav = None
                if error is None:
                    try:
                        tool = tool or factory()
                        wav = tool.to_wav(content, kind) or None
                        error = None if wav else "The converted audio file is empty."
                    except Exception as e:  # noqa: BLE001  a damaged file is that row's error
                        error = f"The audio could not be converted: {e}"
                out.append((wav, error))
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array([w for w, _ in out], pa.binary()), pa.array([e for _, e in out], pa.string())], ["path", "wav", "error"])

    return written(src.mapInArrow(run, "path string, wav binary, error string"), "wav")


class SpeechBackend(Protocol):
    """A speech-to-text service: JSON payload of one clip, or of a batch job's file."""

    def realtime(self, wav: bytes) -> str: ...

    def batch(self, wav: bytes, diarize: bool, speakers: int | None) -> str: ...


def transcribed(clips: DataFrame, factory: Callable[[], SpeechBackend], diarize: bool = False, speakers: int | None = None) -> DataFrame:
    """(``path``, ``transcript``, ``language_code``, ``segments``, ``error``) of (``path``, ``wav``) rows.

    Short clips without diarization go the direct way, others as batch jobs; a failed job's
    first message is the error.  Each clip is sent once.
    """

    def run(batches):
        import pyarrow as pa

        service = None
        for b in batches:
            out = []
            for path, wav in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    seconds, error = wav_header(wav or b"")
                    service = service or factory()
                    short = error is None and seconds < SHORT_SECONDS and not diarize
                    out.append((path, None if error else service.realtime(wav) if short else service.batch(wav, diarize, speakers), error))
                except Exception as e:  # noqa: BLE001  one clip's failure is that row's error
                    out.append((path, None, f"Speech to text failed: {e}"))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)] if out else [pa.array([], pa.string())] * 3, ["path", "payload", "failed"])

    rows = written(clips.select("path", "wav").mapInArrow(run, "path string, payload string, failed string"), "speech")
    got = rows.select("path", F.coalesce("failed", batch_failure(F.col("payload"))).alias("failed"), parse_speech(F.col("payload")).alias("r"))
    field = lambda name: F.when(F.col("failed").isNull(), F.col(f"r.{name}")).alias(name)
    return got.select("path", *map(field, ("transcript", "language_code", "segments")), F.coalesce("failed", "r.error").alias("error"))


def wav_header(data: bytes) -> tuple[float | None, str | None]:
    """(seconds, error): frames over rate, from the chunks of a RIFF file in whatever order."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None, "Not a WAV file."
    at, rate, block = 12, None, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if name == b"fmt ":
            rate, block = int.from_bytes(data[at + 12 : at + 16], "little"), int.from_bytes(data[at + 20 : at + 22], "little")
        if name == b"data":
            if not rate or not block:
                return None, "The WAV file has an invalid sample rate."
            return min(size, len(data) - at - 8) // block / rate, None
        at += 8 + size + size % 2
    return None, "The WAV file has no audio data."


def wav_seconds(files: DataFrame) -> DataFrame:
    """(``path``, ``seconds``, ``error``) of files with ``content``."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            got = [wav_header(x or b"") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s for s, _ in got], pa.float64()), pa.array([e for _, e in got], pa.string())], ["path", "seconds", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, seconds double, error string")


def route(seconds: Column, diarize: Column) -> Column:
    """``realtime`` for short clips without diarization, else ``batch``."""
    return F.when((seconds < SHORT_SECONDS) & ~diarize, F.lit("realtime")).otherwise(F.lit("batch"))


def speech_results(spark: SparkSession, path: str, by: Column | None = None) -> DataFrame:
    """Of each batch folder's ``*.json`` files the first, by name, that holds a transcript."""
    files = spark.read.option("wholetext", "true").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").text(path).select("value", F.col("_metadata.file_path").alias("path"))
    return first_results(files, by)


def first_results(files: DataFrame, by: Column | None = None) -> DataFrame:
    """The same over rows (``path``, ``value``); unreadable JSON is reported before anything else."""
    folder = by if by is not None else F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    rows = files.select(folder.alias("job"), "path", parse_speech(F.col("value")).alias("r"))
    bad = F.min(F.when(F.col("r.error") == "Payload is not valid JSON.", F.col("path")))
    best = F.min_by(F.when(F.col("r.error").isNull(), F.col("r")), F.when(F.col("r.error").isNull(), F.col("path")))
    out = rows.groupBy("job").agg(best.alias("r"), bad.alias("bad"))
    error = F.when(F.col("bad").isNotNull(), F.concat(F.lit("Unreadable result file: "), F.col("bad"))).when(F.col("r").isNull(), F.lit("No transcript was found in the results."))
    return out.select("job", "r.transcript", "r.language_code", "r.segments", error.alias("error"))


def env_file(spark: SparkSession, path: str) -> dict[str, str]:
    """The settings of a ``.env`` file: ``NAME=value`` lines, ``export`` before them or not, values in quotes or up to a comment.

    Inside double quotes ``\\n``, ``\\t``, ``\\"`` and ``\\\\`` stand for those characters.  Of a repeated name the last counts; a missing file has none.
    """
    fs, file = hadoop_path(spark, path)
    if not fs.exists(file):
        return {}
    out = {}
    for m in re.finditer(_ENV_LINE, read_text(fs, file)):
        name, double, single, bare = m.groups()
        shown = {"n": "\n", "t": "\t"}
        out[name] = re.sub(r"\\(.)", lambda x: shown.get(x[1], x[1]), double) if double is not None else single if single is not None else re.sub(r"(^|\s+)#.*", "", bare or "").strip()
    return out


#: A setting's name, and its value in double quotes, in single quotes or bare.
_ENV_LINE = r"""(?m)^[ \t]*(?:export[ \t]+)?([A-Za-z_][A-Za-z0-9_.]*)[ \t]*=[ \t]*(?:"((?:[^"\\]|\\.)*)"|'([^']*)'|([^\r\n]*))"""


def setting(spark: SparkSession, name: str, env_file: dict[str, str] | None = None) -> str | None:
    """A setting from the session, the environment or a given table (see :func:`env_file`), in this order; blank counts as missing."""
    found = (spark.conf.get(f"spark.confab.{name}", None), os.environ.get(name), (env_file or {}).get(name))
    return next((v.strip() for v in found if v and v.strip()), None)


def required_settings(spark: SparkSession, names: list[str], env_file: dict[str, str] | None = None) -> dict[str, str]:
    """All of ``names``; the error lists every one that is missing."""
    got = {n: setting(spark, n, env_file) for n in names}
    if missing := [n for n, v in got.items() if v is None]:
        raise ValueError(f"Missing required settings: {', '.join(missing)}")
    return got
