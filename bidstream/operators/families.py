"""Vocabularies of scope in English, German, French and Spanish, and the rules over them.

All of it is configuration for `lexicon`: a vocabulary is phrases by role, and a caller may pass another. Compounds of German
are listed as they are written; plurals and cases are listed where they are usual.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidstream.operators.lexicon import AFTER, BEFORE, STILL, ClauseRule, Lexicon, Phrase, first_holding, places, standing

#: Phrases by role, separated by commas.
WORDS = {
    BEFORE: """
        no, not, without, excluding, exclude, excludes, except, except for, neither, never, rather than, instead of, other than, does not include, not including,
        kein, keine, keinen, keinem, keiner, nicht, ohne, weder, ausgenommen, mit ausnahme von, statt, anstelle von,
        sans, aucun, aucune, ni, hors, sauf, excepté, ne comprend pas, n inclut pas, à l exclusion de, plutôt que,
        sin, ningún, ninguna, ni, excepto, salvo, no incluye, excluyendo, en lugar de, en vez de""",
    AFTER: """
        is excluded, are excluded, is not required, are not required, is not included, are not included, is not part, are not part, out of scope, is out of scope, not commissioned, will not be supplied,
        entfällt, entfallen, ist nicht enthalten, sind nicht enthalten, ist ausgeschlossen, sind ausgeschlossen, wird nicht benötigt, nicht gegenstand,
        est exclu, est exclue, sont exclus, sont exclues, n est pas compris, ne sont pas compris, n est pas requis, non compris,
        queda excluido, queda excluida, quedan excluidos, quedan excluidas, no está incluido, no está incluida, no se requiere, no requerido""",
    STILL: "not only, not just, no later than, no less than, nicht nur, non seulement, no sólo, no solo, no solamente",
    "delivery": """
        deliver, delivers, delivery of, build, building of, develop, develops, developing, development of, design and build, implement, implements, implementing, implementation of, configure, configuration of,
        migrate, migration of, migration to, modernise, modernize, modernisation of, replace, replacement of, roll out, rollout of, introduce, introduction of, procure and install, supply and install, set up, integrate, integration of,
        entwickeln, entwicklung, entwicklung von, entwicklung einer, einführung, einführung einer, implementierung, implementierung von, programmierung, neuentwicklung, weiterentwicklung, ablösung, bereitstellung, migration, umsetzung, aufbau, konfiguration, anpassung, beschaffung und einführung,
        développer, développement, développement d une, développement d un, réalisation, réalisation d un, mise en œuvre, mise en place, déploiement, conception, refonte, intégration, paramétrage, acquisition et déploiement, migration vers, remplacement, modernisation, création,
        desarrollar, desarrollo, desarrollo de, implantar, implantación, implantación de, implementación, diseño, diseño y desarrollo, despliegue, puesta en marcha, migración, integración, renovación, sustitución, modernización, configuración, parametrización, creación""",
    "software": """
        software, platform, platforms, application, applications, web application, mobile app, app, website, web site, portal, web portal, customer portal, database, databases, api, apis, middleware, information system, information systems, management system, management systems, it system, ict system,
        digital service, digital services, data platform, data warehouse, data hub, dashboard, chatbot, saas, cloud service, prototype, software solution, it solution, workflow engine, case management system, content management system, document management system, self service portal,
        softwarelösung, plattform, fachverfahren, fachanwendung, anwendung, anwendungen, webportal, webanwendung, internetauftritt, datenbank, informationssystem, it system, it lösung, schnittstelle, schnittstellen, dokumentenmanagementsystem, verwaltungssoftware, bürgerportal, datenplattform, app entwicklung,
        logiciel, logiciels, plateforme, plateformes, applicatif, progiciel, progiciels, site internet, site web, portail, base de données, bases de données, système d information, systèmes d information, application mobile, solution logicielle, outil numérique, entrepôt de données, solution informatique,
        plataforma, plataformas, aplicación, aplicaciones, aplicación móvil, portal web, página web, sitio web, base de datos, bases de datos, sistema informático, sistemas informáticos, sistema de información, sistemas de información, solución informática, herramienta informática, gestor documental, sede electrónica""",
    "system": """
        erp, crm, enterprise resource planning, case management, records management, document management, payroll system, hr system, booking system, finance system, procurement system, asset management system, ticketing system, customer relationship management, workforce management, grants management, permit system, licensing system,
        fallmanagement, personalverwaltungssystem, finanzsoftware, kundenmanagement, e akte, dokumentenmanagement, buchungssystem, haushaltssoftware, vergabemanagementsystem, bürgermanagement,
        gestion de la relation client, gestion documentaire, gestion des dossiers, logiciel de paie, logiciel financier, gestion du patrimoine, gestion des marchés, système de réservation, gestion électronique de documents, sirh,
        gestión de expedientes, gestión documental, gestión de la relación con el cliente, sistema de nóminas, sistema económico financiero, gestión de citas, gestión de recursos humanos, sistema de reservas, gestión tributaria, registro electrónico""",
    "digital": """
        digital, digitisation, digitization, digitalisation, digital transformation, it services, ict services, information technology, cyber security, cloud, data services, artificial intelligence, automation,
        digitalisierung, digitale transformation, informationstechnik, it dienstleistungen, edv, künstliche intelligenz, automatisierung, informationssicherheit,
        numérique, transformation numérique, dématérialisation, services informatiques, technologies de l information, intelligence artificielle, cybersécurité, informatique,
        transformación digital, digitalización, servicios informáticos, tecnologías de la información, inteligencia artificial, ciberseguridad, automatización, informática""",
    "channel": """
        using, by means of, via, through, submitted through, uploaded to, upload to, register on, registration on, log in to, published on, available on, accessed through, sent through, listed on, notified through,
        mittels, über, über die, über das, durch nutzung, hochgeladen auf, einzureichen über, registrierung auf, veröffentlicht auf, abrufbar unter,
        au moyen de, via la, via le, par l intermédiaire de, déposées sur, déposer sur, publié sur, publiée sur, accessible sur, transmises par, sur la,
        mediante, a través de, por medio de, presentadas en, presentar en, publicado en, publicada en, disponible en, accesible en, alojado en""",
    "joining": "integration, integrate, integrated, interface, interfaces, interoperability, connection, connecting, integrierung, anbindung, verknüpfung, intégration, interfaçage, interopérabilité, raccordement, integración, interoperabilidad, interconexión, conexión",
    "physical": """
        pipework, pipes, ventilation, air handling, compressed air, heating, boiler, boilers, high voltage, switchgear, wiring, cabling, valves, pumps, welding, steelwork, hull, chassis, gate, gates, actuators, ductwork, refrigeration, sprinklers, scaffolding,
        rohrleitungen, lüftung, heizung, kessel, hochspannung, schaltanlage, verkabelung, pumpen, ventile, stahlbau, fahrwerk, kälteanlage,
        tuyauterie, chauffage, chaudière, haute tension, câblage, vannes, pompes, soudure, charpente, matériel roulant, climatisation, serrurerie,
        tuberías, ventilación, calefacción, caldera, alta tensión, cableado, válvulas, bombas, soldadura, estructura metálica, maquinaria, climatización""",
    "past": """
        formerly, previously, in the past, history of, historical, heritage, museum of, anniversary, archive of, was introduced in, decommissioned, retired in, former,
        ehemalig, ehemalige, ehemaligen, früher, historisch, geschichte der, museum für, jubiläum, stillgelegt,
        ancien, ancienne, historique, histoire de, musée, patrimoine, autrefois, anniversaire,
        antiguo, antigua, histórico, historia de, museo, patrimonio, anteriormente, aniversario""",
    "paper": """
        application form, application forms, paper form, paper forms, by post, planning application, planning applications, job application, job applications, grant application, grant applications, application deadline, application for funding, licence application, letter of application,
        antragsformular, bewerbung, bewerbungen, papierform, postalisch, bauantrag, bauanträge, förderantrag, antragsfrist,
        formulaire de candidature, dossier de candidature, par voie postale, demande de subvention, demande de permis, acte de candidature,
        solicitud en papel, formulario de solicitud, por correo postal, solicitud de subvención, solicitud de licencia, candidatura""",
    "form": "application, applications, anwendung, anwendungen, application mobile, aplicación, aplicaciones, solicitud, demande, antrag",
    "goods": """
        furniture, vehicles, vehicle, uniforms, road works, roof, roofing, catering, cleaning, cleaning services, fuel, food, medicines, medical devices, tyres, windows, doors, playground, landscaping, security guards, waste collection, laptops, desktop computers, printers, network switches, servers, server hardware, storage hardware, laboratory equipment,
        möbel, fahrzeuge, fahrzeug, dienstkleidung, straßenbau, dacharbeiten, verpflegung, reinigung, gebäudereinigung, kraftstoff, lebensmittel, arzneimittel, fenster, türen, spielplatz, bewachung, abfallentsorgung, laptops, drucker, server, laborgeräte, netzwerktechnik,
        mobilier, véhicules, véhicule, habillement, travaux de voirie, toiture, restauration collective, nettoyage, carburant, denrées alimentaires, médicaments, fenêtres, portes, aire de jeux, gardiennage, collecte des déchets, ordinateurs portables, imprimantes, serveurs, matériel de laboratoire,
        mobiliario, vehículos, vehículo, vestuario, obras de carretera, cubierta, comedor, limpieza, combustible, alimentos, medicamentos, ventanas, puertas, parque infantil, vigilancia, recogida de residuos, portátiles, impresoras, servidores, equipos de laboratorio""",
    "vacancy": "vacancy, job vacancy, recruitment of, post of, full time position, stellenangebot, stellenausschreibung, offre d emploi, recrutement d un, recrutement d une, oferta de empleo, convocatoria de plaza, proceso selectivo",
    "care": "training course, training courses, medical treatment, social care, legal advice, home care, childcare, schulung, schulungen, pflege, rechtsberatung, kinderbetreuung, formation professionnelle, soins, conseil juridique, garde d enfants, curso de formación, asistencia sanitaria, asesoría jurídica, ayuda a domicilio",
    "grant": "grant, grants, funding call, call for proposals, subsidy, fördermittel, förderaufruf, zuwendung, subvention, subventions, appel à projets, subvención, subvenciones, convocatoria de ayudas",
    "works": "construction, refurbishment, demolition, renovation of the building, repair of, neubau, sanierung, abbruch, instandsetzung, travaux de construction, réhabilitation, démolition, réfection, construcción, rehabilitación, demolición, reparación de",
    "existing": "existing, current, currently, incumbent, legacy, in place, already in use, installed, bestehend, bestehende, bestehenden, vorhandene, vorhandenen, derzeitige, existant, existante, existants, actuel, actuelle, en place, existente, existentes, actual, actuales, instalado",
    "uncertain": "may, might, could, potentially, consider, explore, if required, optional, optionally, kann, könnte, gegebenenfalls, optional, eventuell, peut, pourrait, éventuellement, le cas échéant, en option, podría, podrá, en su caso, opcional, eventualmente",
}


def vocabulary(words: dict[str, str] = WORDS) -> Lexicon:
    return Lexicon(Phrase(p.strip(), role) for role, listed in words.items() for p in listed.split(",") if p.strip())


#: A thing of software that something is delivered of, in one clause.
DELIVERS = ClauseRule("delivery", "software", near=("delivery",), reach=6)
#: What takes the place of evidence, and the clause that says so: a rule each, tried in this order.
NOT_MEANT = (
    ClauseRule("operational use", "software", near=("channel",), bars=("delivery",), reach=3, order="before"),
    ClauseRule("physical integration", "joining", near=("physical",), bars=("software",)),
    ClauseRule("past", "software", near=("past",), bars=("delivery",)),
    ClauseRule("paper application", "form", near=("paper",), bars=("software", "delivery")),
)
#: Reasons to leave a notice out by its title; any delivery of software in title or text keeps it in.
UNRELATED = (
    ClauseRule("vacancy", "vacancy", bars=("software",)), ClauseRule("goods", "goods", bars=("software", "system")), ClauseRule("works", "works", bars=("software", "system", "digital")),
    ClauseRule("care or training", "care", bars=("software", "system")), ClauseRule("grant", "grant", bars=("software", "system")),
)


def _has(found: Column, role: str) -> Column:
    return F.exists(found, lambda clause: F.size(standing(clause, role)) > 0)


def scope_kind(found: Column) -> Column:
    """business_system, delivery, generic_digital or none: what the clauses of a title and a text say is bought."""
    return F.when(_has(found, "system"), "business_system").when(DELIVERS.holds(found), "delivery").when(_has(found, "digital"), "generic_digital").otherwise("none")


def exclusion(title: Column, text: Column) -> Column:
    """The reason that leaves a notice out, or null: its title's alone, unless title or text deliver software or the title names a system."""
    kept = DELIVERS.holds(title) | DELIVERS.holds(text) | _has(title, "system")
    return F.when(~kept, first_holding(title, UNRELATED))


def description_exclusion(title: Column, text: Column) -> Column:
    """Where the title says nothing, the reason of the first clause of the description that gives one."""
    silent = ~F.exists(title, lambda c: F.exists(c, lambda h: ~h["role"].isin(BEFORE, AFTER, STILL))) & ~DELIVERS.holds(text)
    reasons = F.transform(text, lambda clause: first_holding(F.array(clause), UNRELATED))
    return F.when(silent, F.get(F.array_compact(reasons), 0))


def clause_contexts(found: Column) -> Column:
    """(clause, context) of clauses with a thing of software: uncertain, delivery, existing_system, a rule of NOT_MEANT or mention, the first that holds."""

    def context(clause: Column) -> Column:
        has = lambda role: F.exists(clause, lambda h: h["role"] == role)
        out = F.when(has("uncertain"), "uncertain").when(F.size(DELIVERS.where(clause)) > 0, "delivery").when(has("existing"), "existing_system")
        for rule in NOT_MEANT:
            out = out.when(F.size(rule.where(clause)) > 0, rule.label)
        return out.otherwise("mention")

    about = F.filter(found, lambda clause: F.size(standing(clause, "software", "system")) > 0)
    return F.transform(about, lambda clause: F.struct(F.get(clause, 0)["clause"].alias("clause"), context(clause).alias("context")))


def scoped(notices: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """Notices (title, description ..) with scope, excluded and contexts; each text is read once."""
    lexicon = lexicon or vocabulary()
    read = notices.withColumn("title_", places(F.col("title"), lexicon)).withColumn("text_", places(F.col("description"), lexicon))
    title, text = F.col("title_"), F.col("text_")
    return read.select(
        *notices.columns, scope_kind(F.concat(title, text)).alias("scope"), F.coalesce(exclusion(title, text), description_exclusion(title, text)).alias("excluded"),
        clause_contexts(text).alias("contexts"),
    )
