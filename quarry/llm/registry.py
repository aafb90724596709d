"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from quarry.llm import bytebpe, embeddup, flac, langid, licenses, linededup, lmscore, packing, simhash, warc

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_langid": langid.op2_langid,
    "op3_packing": packing.op3_packing,
    "op4_licenses": licenses.op4_licenses,
    "op5_bytebpe": bytebpe.op5_bytebpe,
    "op6_flac": flac.op6_flac,
    "op7_lmscore": lmscore.op7_lmscore,
    "op8_embeddup": embeddup.op8_embeddup,
    "op9_warc": warc.op9_warc,
    "op10_linededup": linededup.op10_linededup,
}
ORACLE_SQL = {
    "op4_licenses": licenses.OP4_SQL,
    "op8_embeddup": embeddup.OP8_SQL,
    "op9_warc": warc.OP9_SQL,
    "op10_linededup": linededup.OP10_SQL,
}
