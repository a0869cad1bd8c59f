"""Ready-made queries over the driver's tables, each with its SQL counterpart where SQL can say it."""
