"""Reading, assembling and writing documents and nodes."""
