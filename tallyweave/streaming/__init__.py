"""The two incremental loads: timesheet files upserted by key, and invoice batches matched on arrival."""
