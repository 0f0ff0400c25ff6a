"""The query language, search plans and driver-table adapters."""
