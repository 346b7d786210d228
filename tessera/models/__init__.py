"""Networks: a writer of ONNX graphs, the image tower, and frames that run finished models."""
