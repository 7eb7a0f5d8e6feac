"""Queries of the training-data operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import oracles
from .bpe import op5_numpy_bpe
from .decontam import op2_suffix_automaton
from .gif import op7_gif
from .minhash import op4_minhash
from .quality import op10_empirical_bayes
from .sharding import op8_ring_shards
from .substrings import op3_suffix_repeats
from .toxicity import op1_deobfuscated_toxicity
from .warc import op9_zip_warc
from .wavelet import op6_wavelet_matrix

QUERIES = {
    "op1_deobfuscated_toxicity": op1_deobfuscated_toxicity,
    "op10_empirical_bayes": op10_empirical_bayes,
    "op2_suffix_automaton": op2_suffix_automaton,
    "op3_suffix_repeats": op3_suffix_repeats,
    "op4_minhash": op4_minhash,
    "op5_numpy_bpe": op5_numpy_bpe,
    "op6_wavelet_matrix": op6_wavelet_matrix,
    "op7_gif": op7_gif,
    "op8_ring_shards": op8_ring_shards,
    "op9_zip_warc": op9_zip_warc,
}

ORACLE_SQL: dict[str, str] = {
    "op2_suffix_automaton": oracles.OP2_SUFFIX_AUTOMATON,
    "op4_minhash": oracles.OP4_MINHASH,
    "op9_zip_warc": oracles.OP9_ZIP_WARC,
}
