"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bitpack, byte_bpe, divergence, fim, flac, kneser_ney, langid, mixing, pii, simhash, substring, warc, whitening

QUERIES = {
    "op1_flac": flac.op1,
    "op2_substring": substring.op2,
    "op3_pii": pii.op3,
    "op4_divergence": divergence.op4,
    "op5_simhash": simhash.op5,
    "op6_kneser_ney": kneser_ney.op6,
    "op7_byte_bpe": byte_bpe.op7,
    "op8_bitpack": bitpack.op8,
    "op9_langid": langid.op9,
    "op10_mixing": mixing.op10,
    "op11_whitening": whitening.op11,
    "op12_fim": fim.op12,
    "op13_warc": warc.op13,
}

SQL = {
    "op4_divergence": divergence.OP4_SQL,
    "op10_mixing": mixing.OP10_SQL,
    "op12_fim": fim.OP12_SQL,
    "op13_warc": warc.OP13_SQL,
}
