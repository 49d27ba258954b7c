from hypothesis import settings

settings.register_profile("steady", deadline=None)
settings.load_profile("steady")
