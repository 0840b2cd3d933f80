"""DataFrame-to-DataFrame building blocks; none of them runs a job."""
