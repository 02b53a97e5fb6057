"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from cellscore.llm.align import op13_token_alignment
from cellscore.llm.bpe import op1_byte_bpe
from cellscore.llm.decontaminate import op8_benchmark_decontamination
from cellscore.llm.exact import op10_exact_dedup
from cellscore.llm.jaccard import op7_ngram_jaccard_join
from cellscore.llm.licenses import op4_license_scan
from cellscore.llm.lines import op9_line_templates
from cellscore.llm.mixing import op11_source_mix
from cellscore.llm.negatives import op12_hard_negatives
from cellscore.llm.oracles import ORACLES  # noqa: F401
from cellscore.llm.pii import op6_personal_data
from cellscore.llm.quality import op5_quality_crf
from cellscore.llm.repair import op3_token_id_repair
from cellscore.llm.secrets import op2_secret_forest

QUERIES = {
    f.__name__: f
    for f in (
        op1_byte_bpe,
        op2_secret_forest,
        op3_token_id_repair,
        op4_license_scan,
        op5_quality_crf,
        op6_personal_data,
        op7_ngram_jaccard_join,
        op8_benchmark_decontamination,
        op9_line_templates,
        op10_exact_dedup,
        op11_source_mix,
        op12_hard_negatives,
        op13_token_alignment,
    )
}
