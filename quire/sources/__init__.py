"""Reading sources and images, writing images and documents."""
