"""Dated, three-valued policy-rule analytics as PySpark DataFrame plans."""
