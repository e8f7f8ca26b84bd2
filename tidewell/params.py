"""Fixed values of the detection front end and policies, and checks on them."""

from __future__ import annotations

import hashlib

# Front end.
SAMPLE_RATE, CLIP_SAMPLES, FRAME_LEN, STRIDE_LEN, NUM_FRAMES = 16_000, 16_000, 640, 320, 49
NFFT, NUM_MEL, NUM_MFCC, FMIN, FMAX, PREEMPHASIS, LOG_FLOOR = 1024, 40, 10, 20.0, 4000.0, 0.97, 1e-6
HOP_SAMPLES, HOP_MS = 1600, 100
# Detection policy (threshold, votes, window, refractory hops), session policy.
THETA, K, WINDOW, REFRACTORY = 0.75, 3, 5, 10
SILENCE_RMS, SILENCE_HOPS, MAX_HOPS, QUEUE, PREROLL = 0.02, 15, 80, 100, 3
# Splits (percent), quotas (percent of keywords, shares of the unknown quota), the hash's modulus.
TEST_PCT, VAL_PCT, UNKNOWN_PCT, SILENCE_PCT, HARD_NEG_SHARE, TALKING_SHARE, HASH_MOD = 10.0, 10.0, 1000.0, 10.0, 0.25, 0.15, (1 << 27) - 1

assert (CLIP_SAMPLES - FRAME_LEN) // STRIDE_LEN + 1 == NUM_FRAMES
assert FRAME_LEN <= NFFT and 0 < K <= WINDOW and TEST_PCT + VAL_PCT < 100


def contract_hash(pairs: tuple[tuple[str, object], ...]) -> str:
    """First 16 hex digits of the sha256 of an ordered tuple of (name, value) pairs, as Python writes it."""
    return hashlib.sha256(repr(pairs).encode()).hexdigest()[:16]
