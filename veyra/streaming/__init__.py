"""The additive statistics over streams."""
