"""Sources and sinks."""

from clvforge.sources.star import transactions_from_star, transactions_from_events
from clvforge.sources.io import (read_transactions, write_outputs, read_customer_outputs,
                                 save_params, load_params, params_frame, run_metadata)
from clvforge.sources.histories import explode_histories, read_histories, histories_from_lines

__all__ = [
    "transactions_from_star", "transactions_from_events", "read_transactions",
    "write_outputs", "read_customer_outputs", "save_params", "load_params",
    "params_frame", "run_metadata", "explode_histories", "read_histories",
    "histories_from_lines",
]
