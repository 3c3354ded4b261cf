"""Column builders: URLs, text, pay and VARIANT documents."""
