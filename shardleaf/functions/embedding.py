"""Vectors for texts from a backend that is passed in, batch by batch."""

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Backend = Callable[[list[str]], list]


def embed(df: DataFrame, id_col: str, text_col: str, backend: Backend) -> DataFrame:
    """``id_col, embedding`` of every row. A null text, or one for which the backend gives none, has a null vector.

    If a whole batch fails, its texts are tried one by one, so one bad text costs only its own vector.
    """
    given = df.select(id_col, text_col).toDF("_id", "_text")
    schema = T.StructType([given.schema["_id"], T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def one(text: str):
        try:
            return backend([text])[0]
        except Exception:
            return None

    def run(batches):
        for pdf in batches:
            has = pdf["_text"].notna()
            texts = pdf.loc[has, "_text"].tolist()
            try:
                vectors = backend(texts) if texts else []
            except Exception:
                vectors = list(map(one, texts))
            out = pd.Series([None] * len(pdf), index=pdf.index, dtype=object)
            for at, vector in zip(pdf.index[has], vectors):
                out.at[at] = vector
            yield pd.DataFrame({"_id": pdf["_id"], "embedding": out})

    return given.mapInPandas(run, schema).withColumnRenamed("_id", id_col)
