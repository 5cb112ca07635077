"""Recordings to questions: gates as columns, transcoding and transcription as plug-ins that run in the tasks."""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions import text as X

#: (bytes as uploaded) -> (16 kHz mono PCM, the tool's log)
Transcode = Callable[[bytes], tuple[bytes, str]]
#: (PCM, language) -> text
Transcribe = Callable[[bytes, str], str]
LEAST_PCM = 2000


def ffmpeg(timeout: int = 60) -> Transcode | None:
    """The program of that name as a transcoder that measures the volume as well; None where it is not installed."""
    program = shutil.which("ffmpeg")
    if not program:
        return None

    def run(data: bytes) -> tuple[bytes, str]:
        done = subprocess.run([program, "-hide_banner", "-i", "pipe:0", "-af", "volumedetect", "-ac", "1", "-ar", "16000", "-f", "s16le", "pipe:1"], input=data, capture_output=True, timeout=timeout, check=False)
        return done.stdout, done.stderr.decode(errors="replace")

    return run


def audio_gate(audio: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Adds ``status``: ok, small (too few bytes), silent (as far as the measured volume, column ``log``, says), or unreadable (too little PCM)."""
    db = X.volume_db(F.col("log"))
    status = F.when(F.coalesce(F.octet_length("content"), F.lit(0)) < settings.min_audio_bytes, "small")
    if "pcm" in audio.columns:
        status = status.when(F.coalesce(F.octet_length("pcm"), F.lit(0)) < LEAST_PCM, "unreadable")
    return audio.withColumn("status", status.when(F.coalesce(db < settings.min_volume_db, F.lit(False)), "silent").otherwise("ok"))


def transcoded(audio: DataFrame, transcode: Transcode, key: str = "path", settings: Settings = DEFAULTS) -> DataFrame:
    """``key, content, pcm, log`` of recordings; those too small are not handed to the tool, those it fails on have no PCM."""
    kind = dict(audio.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, data in zip(f[key], f["content"], strict=True):
                pcm, log = b"", ""
                if data is not None and len(data) >= settings.min_audio_bytes:
                    try:
                        pcm, log = transcode(bytes(data))
                    except Exception as e:
                        log = str(e)
                rows.append((k, data, pcm, log))
            yield pd.DataFrame(rows, columns=[key, "content", "pcm", "log"])

    return audio.select(key, "content").mapInPandas(run, f"{key} {kind}, content binary, pcm binary, log string")


def spoken_language(asked: Column, p_ar: Column, p_en: Column) -> Column:
    """The language asked for, or Arabic where its probability reaches three quarters of English's or is unknown."""
    return F.when(asked.isin("ar", "en"), asked).when(F.coalesce(p_ar >= 0.75 * p_en, F.lit(True)), "ar").otherwise("en")


def transcripts(audio: DataFrame, transcribe: Transcribe, key: str = "path") -> DataFrame:
    """``key, status, text`` of gated recordings (key, status, pcm, language); a blank or failed transcript is an error, never an answer."""
    kind = dict(audio.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, status, pcm, language in zip(f[key], f["status"], f["pcm"], f["language"], strict=True):
                text = None
                if status == "ok":
                    try:
                        text = transcribe(bytes(pcm), language).strip() or None
                    except Exception:
                        text = None
                    status = "ok" if text else "no speech"
                rows.append((k, status, text))
            yield pd.DataFrame(rows, columns=[key, "status", "text"])

    return audio.select(key, "status", "pcm", "language").mapInPandas(run, f"{key} {kind}, status string, text string")


def heard(recordings: DataFrame, transcode: Transcode, transcribe: Transcribe, language: str = "auto", key: str = "path", settings: Settings = DEFAULTS) -> DataFrame:
    """``key, status, text`` of recordings (key, content[, p_ar, p_en]): transcoded, gated, their language chosen, transcribed."""
    gated = audio_gate(transcoded(recordings, transcode, key, settings), settings)
    known = recordings.select(key, *(F.col(c) if c in recordings.columns else F.lit(None).cast("double").alias(c) for c in ("p_ar", "p_en")))
    return transcripts(gated.join(known, key).withColumn("language", spoken_language(F.lit(language), F.col("p_ar"), F.col("p_en"))), transcribe, key)
