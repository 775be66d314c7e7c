"""Column functions: text, Mermaid and geometry."""
