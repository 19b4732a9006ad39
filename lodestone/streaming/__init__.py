"""Events within the driver. The engine's jobs are batches; there is no stream processing in it."""
