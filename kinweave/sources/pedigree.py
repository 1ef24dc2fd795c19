"""Family tables: a pedigree computed from the customer table, and typed views of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: One statement for Spark and other engines; {customer} is the table.
PEDIGREE = """
WITH p AS (SELECT CAST(c_custkey - (SELECT min(c_custkey) FROM {customer}) + 1 AS INT) AS id FROM {customer}),
g AS (SELECT id, CASE WHEN id<=10 THEN NULL ELSE CAST(FLOOR((id-11)/6.0) AS INT) END AS b, CASE WHEN id<=10 THEN NULL ELSE (id-11)%6 END AS pos FROM p),
q AS (SELECT id,
        CASE WHEN id<=10 THEN CASE WHEN id%2=1 THEN 'M' ELSE 'F' END WHEN pos IN (0,2,4) THEN 'M' ELSE 'F' END AS sex,
        CASE WHEN id<=10 THEN CASE WHEN id%2=1 THEN id+1 ELSE id-1 END WHEN pos<3 THEN id+3 ELSE id-3 END AS sp,
        CASE WHEN id<=10 THEN CAST(FLOOR((id-1)/2.0) AS INT) ELSE 5+3*b+(pos%3) END AS couple,
        CASE WHEN id<=10 THEN NULL ELSE 2*b+CAST(FLOOR(pos/3.0) AS INT) END AS pcouple FROM g)
SELECT c.id, c.sex, f.id AS father_id, m.id AS mother_id, s.id AS spouse_id
FROM q c LEFT JOIN q f ON f.couple=c.pcouple AND f.sex='M'
         LEFT JOIN q m ON m.couple=c.pcouple AND m.sex='F'
         LEFT JOIN q s ON s.id=c.sp
"""


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, sex, father_id, mother_id, spouse_id (null: unknown)."""
    return spark.sql(PEDIGREE, customer=spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey"))
