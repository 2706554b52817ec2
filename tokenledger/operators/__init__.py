"""The ledger's operators: functions of DataFrames and Settings, without actions."""
