"""New files are processed as they come in: a file stream, and the batch pipeline on each part."""
