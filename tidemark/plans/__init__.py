"""Read-side plans and the driver's query set."""
