"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from .decontaminate import op4_decontaminate
from .langid import op2_language
from .licenses import op3_licenses, op3_sql
from .lm import op7_lm
from .media import op9_media
from .passages import op6_passages
from .pieces import op8_sentencepiece
from .quality import op10_quality
from .simhash import op1_simhash
from .tokenfile import op5_token_file

QUERIES = {f.__name__: f for f in (op1_simhash, op2_language, op3_licenses, op4_decontaminate, op5_token_file, op6_passages, op7_lm, op8_sentencepiece, op9_media, op10_quality)}
ORACLES: dict[str, str] = {"op3_licenses": op3_sql()}
