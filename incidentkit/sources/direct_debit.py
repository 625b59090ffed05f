"""Direct-debit collection files (pain.008)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# The part of the message that is read.
TRANSACTION = """
    PmtId struct<EndToEndId: string>,
    InstdAmt struct<_VALUE: decimal(18,2), _Ccy: string>,
    DrctDbtTx struct<MndtRltdInf: struct<MndtId: string, DtOfSgntr: date>>,
    DbtrAgt struct<FinInstnId: struct<BIC: string>>,
    Dbtr struct<Nm: string, PstlAdr: struct<AdrLine: array<string>>>,
    DbtrAcct struct<Id: struct<IBAN: string>>,
    RmtInf struct<Ustrd: string>
"""
HEADER = "MsgId string, CreDtTm timestamp, NbOfTxs bigint, CtrlSum decimal(18,2)"
BATCH = "PmtInfId string, NbOfTxs bigint, CtrlSum decimal(18,2), ReqdColltnDt date"


def read_direct_debits(spark: SparkSession, path: str) -> DataFrame:
    """One row per collected amount."""
    raw = spark.read.format("xml").option("rowTag", "DrctDbtTxInf").schema(TRANSACTION).load(path)
    return raw.select(
        F.col("PmtId.EndToEndId").alias("end_to_end_id"),
        F.col("InstdAmt._VALUE").alias("amount"),
        F.col("InstdAmt._Ccy").alias("currency"),
        F.col("DrctDbtTx.MndtRltdInf.MndtId").alias("mandate_id"),
        F.col("DrctDbtTx.MndtRltdInf.DtOfSgntr").alias("signed_on"),
        F.col("DbtrAgt.FinInstnId.BIC").alias("bic"),
        F.col("Dbtr.Nm").alias("debtor"),
        F.col("Dbtr.PstlAdr.AdrLine").alias("address"),
        F.col("DbtrAcct.Id.IBAN").alias("iban"),
        F.col("RmtInf.Ustrd").alias("remittance"),
    )


def read_dd_header(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: message id, creation time, announced number and sum."""
    raw = spark.read.format("xml").option("rowTag", "GrpHdr").schema(HEADER).load(path)
    return raw.select(
        F.col("MsgId").alias("message_id"),
        F.col("CreDtTm").alias("created"),
        F.col("NbOfTxs").alias("announced_count"),
        F.col("CtrlSum").alias("announced_sum"),
    )


def read_dd_batch(spark: SparkSession, path: str) -> DataFrame:
    """One row per payment batch, with its collection date."""
    raw = spark.read.format("xml").option("rowTag", "PmtInf").schema(BATCH).load(path)
    return raw.select(
        F.col("PmtInfId").alias("batch_id"),
        F.col("NbOfTxs").alias("announced_count"),
        F.col("CtrlSum").alias("announced_sum"),
        F.col("ReqdColltnDt").alias("collect_on"),
    )
