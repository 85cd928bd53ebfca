"""Declared schemas and column names shared by all operators."""

from pyspark.sql import types as T

# Column names of the transaction (invoice line) table.
INVOICE = "invoice"
STOCK = "stock_code"
DESCRIPTION = "description"
QTY = "quantity"
TS = "invoice_ts"
PRICE = "price"
CUST = "customer_id"
COUNTRY = "country"
REVENUE = "revenue"

# Raw transaction file as delivered (eight columns, header row).
RAW_CSV_SCHEMA = T.StructType([
    T.StructField("Invoice", T.StringType()),
    T.StructField("StockCode", T.StringType()),
    T.StructField("Description", T.StringType()),
    T.StructField("Quantity", T.IntegerType()),
    T.StructField("InvoiceDate", T.StringType()),
    T.StructField("Price", T.DoubleType()),
    T.StructField("Customer ID", T.DoubleType()),
    T.StructField("Country", T.StringType()),
])

RAW_TO_OURS = {
    "Invoice": INVOICE, "StockCode": STOCK, "Description": DESCRIPTION,
    "Quantity": QTY, "InvoiceDate": TS, "Price": PRICE,
    "Customer ID": CUST, "Country": COUNTRY,
}

TRANSACTION_SCHEMA = T.StructType([
    T.StructField(INVOICE, T.StringType()),
    T.StructField(STOCK, T.StringType()),
    T.StructField(DESCRIPTION, T.StringType()),
    T.StructField(QTY, T.IntegerType()),
    T.StructField(TS, T.TimestampNTZType()),  # wall clock, no zone
    T.StructField(PRICE, T.DoubleType()),
    T.StructField(CUST, T.LongType()),
    T.StructField(COUNTRY, T.StringType()),
])

# Scoring request rows (one per customer to score).
REQUEST_SCHEMA = T.StructType([
    T.StructField(CUST, T.StringType()),
    T.StructField("frequency", T.DoubleType()),
    T.StructField("recency", T.DoubleType()),
    T.StructField("T", T.DoubleType()),
    T.StructField("monetary_value", T.DoubleType()),
    T.StructField("n_unique_products", T.IntegerType()),
    T.StructField(COUNTRY, T.StringType()),
])

# Customer purchase histories (nested request body).
HISTORY_SCHEMA = T.StructType([
    T.StructField(CUST, T.StringType()),
    T.StructField("transactions", T.ArrayType(T.StructType([
        T.StructField("date", T.StringType()),
        T.StructField("amount", T.DoubleType()),
    ]))),
])
