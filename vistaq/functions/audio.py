"""Sound features inside Arrow functions: log-mel spectrograms of ten-second windows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import packs
from . import sounds

# Fixed values of the spectrogram.
RATE, SECONDS, FFT, HOP, MELS, LOW, HIGH = 48_000, 10, 1024, 480, 64, 50.0, 14_000.0
#: Where the three windows of a long sound begin, as shares of what is over.
SHARES = (0.1, 0.5, 0.9)


def mel(hz: Column) -> Column:
    """The mel scale that is linear up to 1000 Hz and logarithmic above, with 27 steps to a factor of 6.4."""
    return F.when(hz < 1000, hz * 3 / 200).otherwise(15 + F.ln(hz / 1000) * 27 / F.ln(F.lit(6.4)))


def hertz(m: Column) -> Column:
    return F.when(m < 15, m * 200 / 3).otherwise(1000 * F.exp((m - 15) * F.ln(F.lit(6.4)) / 27))


def window_starts(frames: Column, width: Column) -> Column:
    """First frames of a sound's windows: 0 for one that fits a window, else three."""
    over = F.array(*((F.floor((frames - width) * s)).cast("long") for s in SHARES))
    return F.when(frames <= width, F.array(F.lit(0).cast("long"))).otherwise(over)


def frame_starts(samples: Column) -> Column:
    """Where the frames of a padded sound begin."""
    return F.when(samples >= FFT, F.sequence(F.lit(0).cast("long"), samples.cast("long") - FFT, F.lit(HOP).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def mel_filters(rate: int = RATE, n_fft: int = FFT, mels: int = MELS, low: float = LOW, high: float = HIGH) -> np.ndarray:
    """(bins, mels): triangles between neighbouring mel steps, each of area 1."""
    to_mel = lambda f: np.where(f < 1000, f * 3 / 200, 15 + np.log(np.maximum(f, 1e-9) / 1000) * 27 / np.log(6.4))
    to_hz = lambda m: np.where(m < 15, m * 200 / 3, 1000 * np.exp((m - 15) * np.log(6.4) / 27))
    edge = to_hz(np.linspace(to_mel(np.array(low)), to_mel(np.array(high)), mels + 2))
    bins = np.linspace(0, rate / 2, n_fft // 2 + 1)[:, None]
    up, down = (bins - edge[:-2]) / np.diff(edge)[:-1], (edge[2:] - bins) / np.diff(edge)[1:]
    return np.maximum(0, np.minimum(up, down)) * 2 / (edge[2:] - edge[:-2])


def log_mel(sounds: np.ndarray, filters: np.ndarray | None = None, block: int = 256) -> np.ndarray:
    """(sounds, steps, mels) in decibels of sounds of RATE that fill a window each. Both ends are mirrored, and so many steps of all sounds are transformed at once."""
    filters = mel_filters() if filters is None else filters
    hann = np.sin(np.pi * np.arange(FFT) / FFT) ** 2
    mirrored = np.pad(np.asarray(sounds, np.float64), ((0, 0), (FFT // 2, FFT // 2)), mode="reflect")
    places = np.arange(0, mirrored.shape[1] - FFT + 1, HOP)
    out = np.empty((len(mirrored), len(places), filters.shape[1]), np.float32)
    for low in range(0, len(places), block):
        spectrum = np.fft.rfft(mirrored[:, places[low : low + block, None] + np.arange(FFT)] * hann)
        energy = (spectrum.real**2 + spectrum.imag**2) @ filters
        out[:, low : low + block] = 10 * np.log10(np.maximum(energy, 1e-10))
    return out


def filled(sound: np.ndarray) -> np.ndarray:
    """A window of a sound: what is longer is cut, what is shorter repeated whole as often as it fits, and silence."""
    whole = RATE * SECONDS
    out = np.zeros(whole)
    if n := min(len(sound), whole):
        times = whole // n
        out[: n * times] = np.tile(sound[:n], times)
    return out


class Resampler:
    """From one rate to another by a windowed sinc, of which each output sample takes the taps of its phase.

    The filter passes what is below both halves of the rates, but for a narrow band, and stops what is above by 90 dB. An
    output sample depends on the input near it alone, so blocks of any size give the same samples.
    """

    def __init__(self, old: int, new: int, crossings: int = 48, beta: float = 9.0, pass_: float = 0.94):
        self.old, self.new = old, new
        common = math.gcd(old, new)
        self.up, self.down = new // common, old // common
        cutoff = pass_ * min(1.0, new / old)  # as a share of half the old rate
        self.half = math.ceil(crossings / cutoff)
        # tap k of a phase sees the input sample half - k before the output's place
        offsets = np.arange(-self.half, self.half + 1)[None, :] - np.arange(self.up)[:, None] / self.up
        shape = np.i0(beta * np.sqrt(np.maximum(0, 1 - (offsets / (self.half + 1)) ** 2))) / np.i0(beta)
        taps = np.sinc(offsets * cutoff) * cutoff * shape
        self.taps = taps / taps.sum(1, keepdims=True)

    def __call__(self, sound: np.ndarray, block: int = 1 << 14) -> np.ndarray:
        if self.old == self.new or not len(sound):
            return np.asarray(sound, np.float64)
        n = round(len(sound) * self.new / self.old)
        padded = np.pad(np.asarray(sound, np.float64), (self.half, self.half + 2))
        reach, out = np.arange(2 * self.half + 1), np.empty(n)
        for low in range(0, n, block):
            place = np.arange(low, min(n, low + block)) * self.down
            near = padded[np.minimum(place // self.up, len(sound) + 1)[:, None] + reach]
            out[low : low + block] = (near * self.taps[place % self.up]).sum(1)
        return out


def _ranged(file: dict, reader: packs.Reader) -> sounds.Ranged:
    if "content" in file:
        return sounds.Ranged(bytes(file["content"]))
    handle, start, size = reader(file)
    return sounds.Ranged(handle, size, start)


def _windows():
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filters, resamplers, reader = mel_filters(), {}, packs.Reader()
        for pdf in batches:
            for file in pdf.to_dict("records"):
                try:
                    f = _ranged(file, reader)
                    what = sounds.kind(f.at(0, 16))
                    if what not in ("wav", "flac"):
                        raise ValueError(f"no decoder for {what or 'this'}")
                    form = sounds.wav_form(f) if what == "wav" else sounds.flac_form(f)
                    read = sounds.wav_samples if what == "wav" else sounds.flac_samples
                    rate = form[0]
                    frames = form[5] // (form[1] * form[2]) if what == "wav" else form[3]
                    if not frames:
                        raise ValueError("no samples, or their number isn't told")
                    width = rate * SECONDS
                    starts = [0] if frames <= width else [int((frames - width) * s) for s in SHARES]
                    if rate not in resamplers:
                        resamplers[rate] = Resampler(rate, RATE)
                    got = log_mel(np.stack([filled(resamplers[rate](read(f, form, s, width))) for s in starts]), filters)
                except Exception as error:  # one bad file is a row with its error, not a failed job
                    yield pd.DataFrame({"path": [file["path"]], "window": [None], "seconds": [0.0], "mel": [None], "read": [None], "error": [str(error) or type(error).__name__]})
                    continue
                yield pd.DataFrame({"path": file["path"], "window": range(len(starts)), "seconds": round(frames / rate, 1), "mel": [g.reshape(-1) for g in got], "read": f.read, "error": None})

    return run


def log_mels(files: DataFrame) -> DataFrame:
    """A row per window of WAV and FLAC files: path, window, seconds, mel, read (the file's bytes that were read), or error. Where files bring no content they are opened by path, or at their place in a pack (see sources.packs), and of long ones only the windows are read; that needs a file system that pyarrow opens."""
    return files.select("path", *packs.source_of(files)).mapInPandas(_windows(), "path string, window int, seconds double, mel array<float>, read long, error string")


def _lengths():
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = packs.Reader()
        for pdf in batches:
            out = []
            for file in pdf.to_dict("records"):
                try:
                    f = _ranged(file, reader)
                    out.append((file["path"], sounds.kind(f.at(0, 16)), sounds.duration(f), f.read, None))
                except Exception as error:
                    out.append((file["path"], None, None, None, str(error) or type(error).__name__))
            yield pd.DataFrame(out, columns=["path", "kind", "seconds", "read", "error"], dtype=object)

    return run


def durations(files: DataFrame) -> DataFrame:
    """path, kind, seconds, read (bytes), error: how long files are, by their headers; null where that isn't told. At most sounds.BOUND bytes of a file are read, at its front and end, unless files bring their content."""
    return files.select("path", *packs.source_of(files)).mapInPandas(_lengths(), "path string, kind string, seconds double, read long, error string")
