"""Sound features of clips (pid, samples: array<float>, sample_rate): excerpts by slices, spectra by numpy in Arrow batches."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Frames and hops in samples, key profiles, mel bands.
TEMPO_FRAME, TEMPO_HOP, KEY_FRAME, KEY_HOP, TIMBRE_FRAME, TIMBRE_HOP = 1024, 512, 4096, 2048, 2048, 1024
MAJOR = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)
MEL_BANDS, MFCCS, LOW_HZ, TOP_HZ = 26, 13, 20, 11_025
EXCERPT_SECONDS = 30


def excerpt(samples: Column, sample_rate: Column, seconds: int = EXCERPT_SECONDS) -> Column:
    """``seconds`` from a third in, moved to fit; a shorter clip whole."""
    want, size = (sample_rate * seconds).cast("int"), F.size(samples)
    start = F.greatest(F.lit(0), F.least(F.floor(size / 3), size - want)).cast("int")
    return F.when(size <= want, samples).otherwise(F.slice(samples, start + 1, want))


def _frames(x: np.ndarray, size: int, hop: int, n: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, size)[: n * hop : hop][:n] if n > 0 else np.zeros((0, size))


@lru_cache
def _window(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1))


def _spectra(frames: np.ndarray) -> np.ndarray:
    return np.abs(np.fft.rfft(frames * _window(frames.shape[1]), axis=1))


def tempo(x: np.ndarray, rate: int) -> tuple[float, float, bool] | None:
    """(bpm, confidence, ambiguous) from the autocorrelation of rising spectral energy; None if there is too little."""
    n = (len(x) - TEMPO_FRAME) // TEMPO_HOP
    if n < 64:
        return None
    flux = np.append(0, np.maximum(np.diff(_spectra(_frames(x, TEMPO_FRAME, TEMPO_HOP, n)), axis=0), 0).sum(1))
    sums = np.append(0, np.cumsum(flux))
    lo, hi = np.maximum(np.arange(n) - 16, 0), np.minimum(np.arange(n) + 16, n)
    env = np.maximum(flux - (sums[hi] - sums[lo]) / (hi - lo), 0)
    energy, fps = float(env @ env), rate / TEMPO_HOP
    first, last = math.floor(60 / 200 * fps), min(n - 1, math.ceil(60 / 60 * fps))
    if energy == 0 or last <= first:
        return None
    spectrum = np.abs(np.fft.rfft(env, 2 * n)) ** 2
    ac = np.zeros(last + 1)
    ac[first:] = (np.fft.irfft(spectrum)[first : last + 1]) / energy
    lags = np.arange(first + 1, last)
    lags = lags[(ac[lags] >= ac[lags - 1]) & (ac[lags] >= ac[lags + 1])]
    if not len(lags):
        return None
    bpm = 60 * fps / lags
    peak = int(lags[np.argmax(ac[lags] * np.where((bpm >= 90) & (bpm <= 180), 1.05, 1.0))])
    a, b, c = ac[peak - 1 : peak + 2]
    bend = a - 2 * b + c
    lag = peak + (float(np.clip(0.5 * (a - c) / bend, -0.5, 0.5)) if bend else 0.0)
    rivals = [v for v in (math.floor(lag * 2 + 0.5), math.floor(lag / 2 + 0.5)) if first <= v <= last]
    return math.floor(60 * fps / lag * 10 + 0.5) / 10, float(np.clip(b, 0, 1)), any(ac[v] > 0.9 * b for v in rivals)


@lru_cache
def _pitches(rate: int) -> tuple[np.ndarray, np.ndarray]:
    """The bins that count for the key, and their pitch classes."""
    step = rate / KEY_FRAME
    bins = np.arange(math.ceil(60 / step), min(KEY_FRAME // 2, math.floor(5000 / step)) + 1)
    return bins, np.floor(69 + 12 * np.log2(bins * step / 440) + 0.5).astype(int) % 12


def key(x: np.ndarray, rate: int) -> tuple[str, float] | None:
    """(Camelot code, confidence) of the profile that fits the pitch classes best; None in silence."""
    power = (_spectra(_frames(x, KEY_FRAME, KEY_HOP, max(0, (len(x) - KEY_FRAME) // KEY_HOP))) ** 2).sum(0)
    bins, pitch = _pitches(rate)
    chroma = np.bincount(pitch, power[bins], 12)
    if chroma.sum() == 0:
        return None
    scores = sorted(((float(np.nan_to_num(np.corrcoef(np.roll(chroma, -t), p)[0, 1])), t, m) for t in range(12) for m, p in ((False, MAJOR), (True, MINOR))), key=lambda s: -s[0])
    (best, tonic, minor), second = scores[0], scores[1][0]
    if best <= 0:
        return None
    sure = min(1.0, max(0.0, best * 0.5 + max(0.0, best - second) * 5))
    return f"{((tonic + (3 if minor else 0)) * 7 + 7) % 12 + 1}{'A' if minor else 'B'}", math.floor(sure * 100 + 0.5) / 100


@lru_cache
def _mel_bank(rate: int) -> np.ndarray:
    """Triangles over the bins, evenly spaced in mel up to the top frequency."""
    mel, hz = (lambda f: 2595 * np.log10(1 + f / 700)), (lambda m: 700 * (10 ** (m / 2595) - 1))
    edges = hz(np.linspace(mel(LOW_HZ), mel(min(TOP_HZ, rate / 2)), MEL_BANDS + 2))
    f = np.arange(TIMBRE_FRAME // 2 + 1) * rate / TIMBRE_FRAME
    up = (f - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - f) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down))


def timbre(x: np.ndarray, rate: int) -> np.ndarray | None:
    """36 numbers: means and deviations of 12 cepstral coefficients; of centroid, rolloff and flatness; bandwidth,
    crossings, loudness and its relative deviation, onsets a second, percussivity. None with under 8 audible frames."""
    if rate <= 0 or len(x) < 4 * TIMBRE_FRAME:
        return None
    frames = _frames(x, TIMBRE_FRAME, TIMBRE_HOP, (len(x) - TIMBRE_FRAME) // TIMBRE_HOP + 1)
    loud = np.sqrt((frames**2).mean(1))
    spectra = _spectra(frames)
    body = spectra[:, 1:]
    total = body.sum(1)
    heard = (loud >= 1e-4) & (total > 0)
    if heard.sum() < 8:
        return None
    after = heard[1:] & heard[:-1]
    flux = (np.maximum(np.diff(body, axis=0), 0).sum(1) / np.where(total[1:] > 0, total[1:], 1))[after]
    crossings = ((frames[:, 1:] >= 0) != (frames[:, :-1] >= 0)).sum(1)[loud >= 1e-4] / TIMBRE_FRAME
    spectra, body, total = spectra[heard], body[heard], total[heard]
    f = np.arange(1, body.shape[1] + 1) * rate / TIMBRE_FRAME
    centroid = body @ f / total
    flat = np.exp(np.log(body + 1e-10).mean(1)) / (total / body.shape[1])
    rolloff = f[(np.cumsum(body, axis=1) >= 0.85 * total[:, None]).argmax(1)]
    width = np.sqrt(np.maximum(0, (body @ f**2) / total - centroid**2))
    mel = np.log(spectra @ _mel_bank(rate).T + 1e-10)
    k = np.arange(MFCCS)[:, None]
    cepstra = mel @ np.cos(np.pi * k * (np.arange(MEL_BANDS) + 0.5) / MEL_BANDS).T / math.sqrt(MEL_BANDS)
    level = loud[loud >= 1e-4]
    high = flux.mean() + flux.std() if len(flux) else 0.0
    peaks = int(((flux[1:-1] > high) & (flux[1:-1] >= flux[:-2]) & (flux[1:-1] > flux[2:])).sum()) if len(flux) > 2 else 0
    tail = [centroid.mean(), centroid.std(), rolloff.mean(), rolloff.std(), flat.mean(), flat.std(), width.mean(), crossings.mean(), level.mean(), level.std() / level.mean(), peaks / (len(cepstra) * TIMBRE_HOP / rate), flux.std() / flux.mean() if len(flux) and flux.mean() > 0 else 0.0]
    return np.concatenate([cepstra[:, 1:].mean(0), cepstra[:, 1:].std(0), tail])


def analyze_clips(clips: DataFrame, partitions: int | None = None) -> DataFrame:
    """(pid, bpm, bpm_conf, ambiguous, key, key_conf, timbre, error) of each clip's excerpt; one bad clip is one error.

    Clips are large, so batches are small; the samples leave with the batch.
    """

    columns = ["pid", "bpm", "bpm_conf", "ambiguous", "key", "key_conf", "timbre", "error"]

    def run(batches):
        for pdf in batches:
            out = []
            for pid, samples, rate in zip(pdf.pid, pdf.samples, pdf.sample_rate, strict=True):
                row = dict.fromkeys(columns) | {"pid": pid}
                try:
                    x = np.asarray(samples, np.float64)
                    row |= dict(zip(("bpm", "bpm_conf", "ambiguous"), tempo(x, rate) or (None, None, None), strict=True))
                    row |= dict(zip(("key", "key_conf"), key(x, rate) or (None, None), strict=True))
                    t = timbre(x, rate)
                    row["timbre"] = None if t is None else t.astype(np.float32)
                except (TypeError, ValueError, ZeroDivisionError) as e:
                    row["error"] = str(e) or type(e).__name__
                out.append(row)
            yield pd.DataFrame(out, columns=columns)

    cut = clips.select("pid", excerpt(F.col("samples"), F.col("sample_rate")).alias("samples"), "sample_rate")
    cut = cut.repartition(partitions, "pid") if partitions else cut
    return cut.mapInPandas(run, "pid string, bpm double, bpm_conf double, ambiguous boolean, key string, key_conf double, timbre array<float>, error string")
