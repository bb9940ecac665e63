"""First JSON value inside free text: a small helper for replies that plain parsing cannot read."""

from pyspark.sql import Column, functions as F


def first_json(c: Column) -> Column:
    import json

    import pandas as pd

    def first(text):
        decoder = json.JSONDecoder()
        for i, ch in enumerate(text or ""):
            if ch in "{[":
                try:
                    _, end = decoder.raw_decode(text, i)
                except ValueError:
                    continue
                return text[i:end]
        return None

    def scan(texts: pd.Series) -> pd.Series:
        return texts.map(first)

    return F.pandas_udf(scan, "string")(c)
