"""Explicit schemas. No reader infers one."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields.items()])


_long, _int, _dbl, _str, _ts = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.TimestampType()

COMPOUNDS = _struct(id=_long, zinc_id=_str, smiles=_str, tranche=_str, mw=_dbl, logp=_dbl)
TRANCHE_STATUS = _struct(tranche=_str, status=_str)
INGESTION_ERRORS = _struct(zinc_id=_str, original_smiles=_str, error_msg=_str, tranche=_str)
SCORES = _struct(
    compound_id=_long, target=_str, experiment_id=_str, al_round=_int, score=_dbl, docked_at=_ts
)
BATCHES = _struct(compound_id=_long, target=_str, experiment_id=_str, round=_int, source=_str)
PREDICTIONS = _struct(id=_long, predicted=_dbl)
FINGERPRINTS = _struct(id=_long, fp=T.ArrayType(_long))
ROUND_METRICS = _struct(
    timestamp=_ts, round=_int, target=_str, experiment_id=_str, n_valid=_long, n_failed=_long,
    best1=_dbl, best10=_dbl, best100=_dbl, best1000=_dbl, mean=_dbl,
    n_screened_cumulative=_long, val_rmse=_dbl, n_train=_long,
)
TRAINING_METRICS = _struct(val_rmse=_dbl, n_train=_long, n_val=_long, best_docking_score=_dbl)
# Every progress cell is read as text, so that one bad cell spoils one row, not the file.
PROGRESS_TEXT = _struct(
    docked=_str, valid=_str, failed=_str, best1=_str, best10=_str, best100=_str, best1000=_str,
    elapsed_s=_str, timestamp=_str,
)
EMBEDDING_2D = _struct(id=_long, x=_dbl, y=_dbl, score=_dbl, al_round=_int)
