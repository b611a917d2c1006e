"""Row-wise operators over unbounded inputs."""
