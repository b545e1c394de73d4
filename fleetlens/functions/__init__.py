"""Column-level helpers (strings, arrays, maps); all built-in expressions,
no Python UDFs, so they stay inside whole-stage codegen."""
