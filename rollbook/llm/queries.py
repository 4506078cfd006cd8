"""The registered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rollbook.llm import chat, collocations, embeddings, packing, repair, urls
from rollbook.llm.decontamination import op5_decontamination
from rollbook.llm.language import op10_language
from rollbook.llm.licenses import op4_licenses
from rollbook.llm.pii import op1_pii
from rollbook.llm.pieces import op3_sentencepiece
from rollbook.llm.quality import op2_quality
from rollbook.llm.simhash import op9_simhash

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_quality": op2_quality,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_licenses": op4_licenses,
    "op5_decontamination": op5_decontamination,
    "op6_chat": chat.op6_chat,
    "op7_embeddings": embeddings.op7_embeddings,
    "op8_url_filter": urls.op8_url_filter,
    "op9_simhash": op9_simhash,
    "op10_language": op10_language,
    "op11_repair": repair.op11_repair,
    "op12_packing": packing.op12_packing,
    "op13_collocations": collocations.op13_collocations,
}

ORACLE: dict[str, str] = {
    "op6_chat": chat.ORACLE,
    "op7_embeddings": embeddings.ORACLE,
    "op8_url_filter": urls.ORACLE,
    "op11_repair": repair.ORACLE,
    "op13_collocations": collocations.ORACLE,
}
