"""Writers of manifests and training targets."""
