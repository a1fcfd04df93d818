"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from strandline.llm.ann import op1_nearest
from strandline.llm.audio import op9_audio
from strandline.llm.audit import audit_sql, op13_audit
from strandline.llm.katz import op7_katz
from strandline.llm.mixing import mixing_sql, op5_mixing
from strandline.llm.packing import op3_packing
from strandline.llm.phrases import op12_phrases, phrases_sql
from strandline.llm.pii import op4_pii
from strandline.llm.quality import op6_quality
from strandline.llm.secrets import op10_secrets
from strandline.llm.simhash import op2_simhash
from strandline.llm.tokenfile import op8_token_files
from strandline.llm.urlfilter import op11_urls, url_sql

QUERIES = {f.__name__: f for f in (op1_nearest, op2_simhash, op3_packing, op4_pii, op5_mixing, op6_quality, op7_katz, op8_token_files, op9_audio, op10_secrets, op11_urls, op12_phrases, op13_audit)}
SQL: dict[str, str] = {"op5_mixing": mixing_sql(), "op11_urls": url_sql(), "op12_phrases": phrases_sql(), "op13_audit": audit_sql()}
