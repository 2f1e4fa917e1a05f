"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import merkle, minhash, repair, sharding, warc
from .additive import op7_additive_ann
from .bpe import op3_bpe_words
from .merkle import op13_merkle_manifest
from .minhash import op10_minhash_near
from .ogg import op4_media_ogg
from .packing import op8_bestfit_packing
from .pieces import op12_piece_words
from .quality import op2_quality_ftrl
from .repair import op11_conversation_repair
from .sharding import op1_sharding_bytes
from .tokencount import op5_token_counts
from .toxicity import op6_toxicity_nnpu
from .warc import op9_warc_seekable

QUERIES = {
    f.__name__: f
    for f in (
        op1_sharding_bytes, op2_quality_ftrl, op3_bpe_words, op4_media_ogg, op5_token_counts, op6_toxicity_nnpu, op7_additive_ann, op8_bestfit_packing, op9_warc_seekable, op10_minhash_near,
        op11_conversation_repair, op12_piece_words, op13_merkle_manifest,
    )
}

ORACLE_SQL: dict[str, str] = {"op10_minhash_near": minhash.ORACLE, "op11_conversation_repair": repair.ORACLE, "op13_merkle_manifest": merkle.ORACLE, "op1_sharding_bytes": sharding.ORACLE, "op9_warc_seekable": warc.ORACLE}
