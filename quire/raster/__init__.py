"""Images: as rows of pixels with column functions, and as buffers with numpy."""
