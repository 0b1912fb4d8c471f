"""From votes to a score and a decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.sources.requests import response_json

MOST_VOTES = 5
FRAUD_VOTES = 3


def fraud_score(votes: Column) -> Column:
    return (F.least(votes, F.lit(MOST_VOTES)) / float(MOST_VOTES)).cast("double")


def approved(votes: Column) -> Column:
    return votes < FRAUD_VOTES


def decide(voted: DataFrame) -> DataFrame:
    """Add fraud_score, approved and the response body to rows with ``votes``."""
    v = F.col("votes")
    return voted.withColumn("fraud_score", fraud_score(v)).withColumn("approved", approved(v)).withColumn("response", response_json(v))
