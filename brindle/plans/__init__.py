"""SQL text: statements, dialect rewrites and generators."""
