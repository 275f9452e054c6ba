"""SQL registration of the functions and a policy registry."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from sievewright.functions import text as T


@udtf(returnType="piece int, piece_text string")
class PackText:
    """Pieces of a text of at most so many characters."""

    def eval(self, text: str, limit: int):
        yield from enumerate(T.pack_text(text, limit), 1)


def register(spark: SparkSession) -> None:
    """normalize_text, deflate_permille, lz77_permille, simhash and pack_text for SQL."""
    spark.udf.register("normalize_text", T.normalize_text)
    spark.udf.register("deflate_permille", T.deflate_permille)
    spark.udf.register("lz77_permille", T.lz77_permille)
    spark.udf.register("simhash", T.simhash())
    spark.udtf.register("pack_text", PackText)
