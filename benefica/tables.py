"""Domain tables derived from the driver's parquet tables.

Every derivation is one SELECT in the dialect that Spark SQL and the checking
engine share, so both sides of a comparison start from the same rows.
``{name}`` marks an input: a parquet table or another derived table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

DERIVED: dict[str, str] = {
    "registrant": """
        SELECT c_custkey AS partner_id, c_name AS name, c_acctbal AS income, c_nationkey AS zone_id,
               c_mktsegment AS kind, c_custkey % 5 = 0 AS is_group,
               CASE WHEN c_acctbal < -500 THEN false WHEN c_acctbal < 500 THEN NULL ELSE true END AS active,
               CASE WHEN c_acctbal > 9800 THEN true WHEN c_acctbal > 9000 THEN NULL ELSE false END AS is_company,
               CASE WHEN c_acctbal BETWEEN 4000 AND 4200 THEN NULL ELSE true END AS is_registrant,
               CASE WHEN c_nationkey % 3 = 0 THEN 'Male' WHEN c_nationkey % 3 = 1 THEN 'Female' END AS gender,
               CASE WHEN c_nationkey = 24 THEN NULL
                    ELSE DATE '1935-03-01' + CAST(c_custkey * 37 % 24000 AS INT) END AS birthdate,
               DATE '1996-01-01' + CAST(c_custkey * 11 % 2000 AS INT) AS create_date,
               DATE '1997-01-01' + CAST(c_custkey * 7 % 1900 AS INT) AS write_date,
               CASE WHEN c_custkey % 13 = 0 THEN DATE '2000-06-01' END AS disabled,
               c_nationkey % 4 AS company_id,
               CASE WHEN c_acctbal > 8000 THEN 2 WHEN c_acctbal > 7000 THEN 1 ELSE 0 END AS supplier_rank
        FROM {customer}""",
    "reg_id": """
        SELECT c_custkey AS partner_id, 'National ID' AS id_type,
               'N' || CAST(c_nationkey AS STRING) || '-' || CAST(CAST(floor(c_acctbal / 10) AS BIGINT) AS STRING)
                   AS value,
               CASE WHEN c_custkey % 7 = 0 THEN NULL
                    ELSE DATE '2000-01-01' + CAST(c_custkey * 17 % 1500 AS INT) END AS expiry_date,
               CASE WHEN c_custkey % 9 = 0 THEN 'invalid' ELSE 'valid' END AS status
        FROM {customer}
        UNION ALL
        SELECT c_custkey, 'Household ID',
               'H' || substr(c_mktsegment, 1, 1) || CAST(CAST(floor(c_acctbal / 5) AS BIGINT) AS STRING),
               CAST(NULL AS DATE), 'valid'
        FROM {customer} WHERE c_nationkey < 12""",
    "phone_number": """
        SELECT c_custkey * 2 AS phone_id, c_custkey AS partner_id,
               '0' || CAST(c_nationkey + 10 AS STRING) || ' ' ||
                   CAST(CAST(floor(c_acctbal / 100) + 100000 AS BIGINT) AS STRING) AS phone_no,
               CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE '0' || CAST(c_nationkey + 10 AS STRING) || ' ' ||
                   CAST(CAST(floor(c_acctbal / 100) + 100000 AS BIGINT) AS STRING) END AS phone_sanitized,
               CASE WHEN c_custkey % 11 = 0 THEN DATE '2001-01-01' END AS disabled
        FROM {customer}
        UNION ALL
        SELECT c_custkey * 2 + 1, c_custkey,
               '0' || substr(c_mktsegment, 1, 1) || CAST(CAST(floor(c_acctbal / 20) AS BIGINT) AS STRING), NULL,
               CAST(NULL AS DATE)
        FROM {customer} WHERE c_mktsegment IN ('HOUSEHOLD', 'BUILDING')""",
    "bank_account": """
        SELECT c_custkey AS account_id, c_custkey AS partner_id,
               'AC' || CAST(CAST(floor(c_acctbal / 4) AS BIGINT) AS STRING) AS acc_number,
               CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN NULL
                    ELSE 'AC' || CAST(CAST(floor(c_acctbal / 4) AS BIGINT) AS STRING) END AS sanitized_acc_number,
               c_custkey % 10 <> 0 AS active
        FROM {customer}
        UNION ALL
        SELECT c_custkey + 1000000000, c_custkey,
               'SV' || CAST(CAST(floor(c_acctbal / 15) AS BIGINT) AS STRING), NULL, true
        FROM {customer} WHERE c_nationkey % 2 = 0""",
    "group_membership": """
        SELECT c_custkey - c_custkey % 5 AS group_id, c_custkey AS individual_id,
               CASE WHEN c_custkey % 5 = 1 THEN 'head' WHEN c_custkey % 5 = 2 THEN 'spouse' ELSE 'child' END AS kind,
               DATE '1998-01-01' + CAST(c_custkey % 700 AS INT) AS start_date,
               CASE WHEN c_custkey % 17 = 0 THEN DATE '1999-03-01' END AS ended_date
        FROM {customer} WHERE c_custkey % 5 <> 0
        UNION ALL
        SELECT c_nationkey * 5, c_custkey, 'head', DATE '1999-01-01', CAST(NULL AS DATE)
        FROM {customer} WHERE c_custkey % 5 <> 0 AND c_acctbal > 8500""",
    "program_membership": """
        SELECT o_custkey * 10 + CAST(substr(o_orderpriority, 1, 1) AS INT) AS membership_id, o_custkey AS partner_id,
               CAST(substr(o_orderpriority, 1, 1) AS INT) AS program_id,
               CAST(min(o_orderdate) AS DATE) AS enrollment_date,
               CASE count(*) % 4 WHEN 1 THEN 'enrolled' WHEN 2 THEN 'draft' WHEN 3 THEN 'exited'
                    ELSE 'not_eligible' END AS state
        FROM {orders} GROUP BY o_custkey, o_orderpriority""",
    "entitlement": """
        SELECT o_orderkey AS entitlement_id, o_custkey AS partner_id,
               CAST(substr(o_orderpriority, 1, 1) AS INT) AS program_id,
               CAST(substr(o_orderpriority, 1, 1) AS INT) * 1000 + (year(o_orderdate) - 1990) * 4
                   + quarter(o_orderdate) AS cycle_id,
               o_totalprice AS initial_amount,
               CASE WHEN o_orderkey % 4 = 0 THEN 12.5 ELSE 0.0 END AS transfer_fee,
               CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'draft' ELSE 'pending_validation' END AS state,
               CAST(o_orderdate AS DATE) AS valid_from,
               CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 AS INT) AS valid_until,
               'E' || CAST(o_orderkey % 997 AS STRING) AS code
        FROM {orders}""",
    "cycle": """
        SELECT cycle_id, min(program_id) AS program_id, min(valid_from) AS start_date, max(valid_from) AS end_date,
               CASE cycle_id % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'draft' WHEN 2 THEN 'to_approve'
                    ELSE 'ended' END AS state
        FROM {entitlement} GROUP BY cycle_id""",
    "payment": """
        SELECT l_orderkey AS entitlement_id, l_extendedprice AS amount_issued,
               CASE WHEN l_returnflag = 'R' THEN 0.0 ELSE l_extendedprice END AS amount_paid,
               CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'paid' ELSE 'issued' END AS status,
               CAST(l_shipdate AS DATE) AS paid_on, l_suppkey AS agency_id
        FROM {lineitem}""",
    "disbursement": """
        SELECT 'D' || CAST(o_orderkey AS STRING) AS disbursement_id,
               'V' || CAST(year(o_orderdate) * 10 + quarter(o_orderdate) AS STRING) AS envelope_id,
               'B' || CAST(year(o_orderdate) * 10 + quarter(o_orderdate) AS STRING) || '-' ||
                   substr(o_orderpriority, 1, 1) AS batch_id,
               o_custkey AS beneficiary_id,
               CASE WHEN o_orderkey % 40 = 0 THEN 0.0 WHEN o_orderkey % 97 = 0 THEN -5.0 ELSE o_totalprice END
                   AS quantity,
               CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN NULL
                    ELSE 'Payee ' || CAST(o_custkey AS STRING) END AS beneficiary_name,
               CASE WHEN o_orderkey % 61 = 0 THEN '' ELSE 'Support ' || o_orderpriority END AS narrative,
               CASE WHEN o_orderstatus = 'P' THEN 'CANCELLED' ELSE 'NOT_CANCELLED' END AS cancellation_status
        FROM {orders}""",
    "envelope": """
        SELECT envelope_id, 'P' || substr(max(envelope_id), 6, 1) AS program_mnemonic,
               count(*) + CASE WHEN max(beneficiary_id) % 3 = 0 THEN 5 ELSE 0 END AS declared_n,
               round(sum(quantity), 2) + CASE WHEN max(beneficiary_id) % 5 = 0 THEN 1000.0 ELSE 0.0 END
                   AS declared_total,
               CASE WHEN count(*) % 2 = 0 THEN DATE '2002-01-01' ELSE DATE '2002-02-01' END AS schedule_date,
               CASE WHEN count(*) % 9 = 0 THEN 'CANCELLED' ELSE 'NOT_CANCELLED' END AS cancellation_status,
               CASE count(*) % 4 WHEN 0 THEN 'PENDING_CHECK' WHEN 1 THEN 'FUNDS_NOT_AVAILABLE'
                    ELSE 'FUNDS_AVAILABLE' END AS funds_status
        FROM {disbursement} GROUP BY envelope_id""",
    "geo_resolution": """
        SELECT c_custkey AS beneficiary_id, n_nationkey AS zone_small, n_regionkey AS zone_large
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey WHERE c_acctbal > -800""",
    "statement_line": """
        SELECT 'S' || CAST(l_suppkey AS STRING) || '-' || CAST(year(l_shipdate) * 100 + month(l_shipdate) AS STRING)
                   AS statement_id, CAST(year(l_shipdate) * 100 + month(l_shipdate) AS BIGINT) * 1000000 + l_suppkey
                   AS statement_order,
               CASE WHEN l_linenumber = 7 THEN 'G' || CAST(l_partkey % 40 AS STRING)
                    WHEN l_linenumber = 6 AND l_partkey % 4 = 0 THEN 'X' || CAST(l_orderkey AS STRING)
                    ELSE 'D' || CAST(l_orderkey AS STRING) END AS reconciliation_id,
               CASE WHEN l_returnflag = 'R' THEN 'RD' WHEN l_linenumber = 5 AND l_returnflag = 'N' THEN 'C' ELSE 'D' END
                   AS indicator,
               l_extendedprice AS amount, CAST(l_shipdate AS DATE) AS value_date,
               'BK' || CAST(l_orderkey AS STRING) || 'L' || CAST(l_linenumber AS STRING) AS reference,
               l_orderkey AS o1, l_linenumber AS o2, l_partkey AS o3, l_shipdate AS o4, l_extendedprice AS o5,
               l_discount AS o6, l_tax AS o7, l_quantity AS o8
        FROM {lineitem}""",
    "id_fa_mapping": """
        SELECT 'ID' || CAST(c_custkey AS STRING) AS id_value, c_custkey AS beneficiary_id,
               CASE WHEN c_custkey % 3 = 0 THEN
                      'account_number:' || CAST(c_custkey + 70000 AS STRING) || '.branch_code:BR' ||
                      CAST(c_nationkey AS STRING) || '.bank_code:BK' || CAST(c_nationkey % 7 AS STRING) ||
                      '.mobile_number:.email_address:.fa_type:BANK_ACCOUNT'
                    WHEN c_custkey % 3 = 1 THEN
                      'mobile_number:' || CAST(c_custkey + 900000 AS STRING) ||
                      '.wallet_provider_name:Wal.wallet_provider_code:W' || CAST(c_nationkey % 5 AS STRING) ||
                      '.fa_type:MOBILE_WALLET'
                    ELSE 'email_address:u' || CAST(c_custkey AS STRING) ||
                      '@x.org.wallet_provider_name:Pay.wallet_provider_code:P' || CAST(c_nationkey % 5 AS STRING) ||
                      '.fa_type:EMAIL_WALLET' END AS fa_value,
               c_name AS name
        FROM {customer} WHERE c_acctbal >= 0""",
    "change_event": """
        SELECT event_id, user_id AS record_id, ts, event_type AS op, value, props FROM {events}""",
    "labelled_score": """
        SELECT l.doc_id AS row_id, l.quality AS label,
               CAST(d.n_chars % 997 AS DOUBLE) / 997.0 * 0.7 + l.quality * 0.3 AS score,
               d.source AS scenario
        FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id""",
}


class Tables:
    """Attribute access to the parquet tables and the derived ones."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        elif name in DERIVED:
            text = DERIVED[name]
            df = self.spark.sql(text, **{n: getattr(self, n) for n in inputs_of(text)})
        else:
            raise AttributeError(name)
        setattr(self, name, df)  # the plan is kept, not the rows
        return df


def inputs_of(text: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", text)))


def prelude(sql: str) -> str:
    """Prefix ``sql`` with the derivations it mentions, as common table expressions."""
    needed: list[str] = []

    def add(name: str) -> None:
        for n in inputs_of(DERIVED[name]):
            if n in DERIVED:
                add(n)
        if name not in needed:
            needed.append(name)

    for name in DERIVED:
        if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql):
            add(name)
    if not needed:
        return sql.strip()
    parts = []
    for n in needed:
        text = DERIVED[n]
        parts.append(f"{n} AS ({text.format(**{i: i for i in inputs_of(text)})})")
    body = sql.strip()
    rest = re.sub(r"^WITH(\s+RECURSIVE)?\s+", ", ", body) if body.startswith("WITH") else " " + body
    recursive = "RECURSIVE " if body.startswith("WITH RECURSIVE") else ""
    return f"WITH {recursive}" + ", ".join(parts) + rest
