"""Schemas of the tables that the pipelines read and write; every column is nullable."""

from pyspark.sql import types as T


def _of(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_S, _I, _L, _D, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.TimestampNTZType()

#: Sales sheet as delivered; names with spaces as in its header.
RAW_SALES = T.StructType([T.StructField(n, t) for n, t in (("Invoice", _S), ("StockCode", _S), ("Description", _S), ("Quantity", _I), ("InvoiceDate", _TS), ("Price", _D), ("Customer ID", _D), ("Country", _S))])
#: Column of the sheet -> column of transactions.
RENAMED = {"Invoice": "invoice_no", "StockCode": "stock_code", "Description": "description", "Quantity": "quantity", "InvoiceDate": "invoice_date", "Price": "unit_price", "Customer ID": "customer_id", "Country": "country"}

TRANSACTIONS = _of(invoice_no=_S, stock_code=_S, description=_S, quantity=_I, invoice_date=_TS, unit_price=_D, customer_id=_D, country=_S)
WEEKLY_FEATURES = _of(week=_TS, stock_code=_S, weekly_sales=_L, lag_1_week=_D, lag_2_week=_D, rolling_4_wk_avg=_D, month=_I)
CUSTOMER_SEGMENTS = _of(customer_id=_D, recency=_L, frequency=_L, monetary=_D, cluster=_I, segment_label=_S)
RUNS = _of(run_name=_S, kind=_S, key=_S, value=_S)
